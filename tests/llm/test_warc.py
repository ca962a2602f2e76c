import gzip
import hashlib
import random

import pytest
from pyspark.sql import types as T

from quarry.llm import warc

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                       T.StructField("html", T.StringType())]
                      + [T.StructField(c, T.StringType()) for c in ("sha1", "payload", "chunk_no", "refers_to", "data")])


def pages(spark, rows):
    return spark.createDataFrame([(*r, *"abcde") for r in rows], SCHEMA)


def expected(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    out = set()
    for i, _, h in rows:
        body = (h or "").encode()
        last = max(groups[body])
        again = len(body) >= 1000 and i != last
        out.add((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last if again else None))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    big = "".join(rng.choice("abc é漢\r\n") for _ in range(40_000))
    same = "s" * 1000
    out = [(1, "http://a", None), (2, None, ""), (3, "http://b\r\nX: y", "é" * 499), (4, "u", "é" * 500), (5, "u", "é" * 500),
           (6, "u", big), (9, "u", big), (7, "u", "x" * 999), (8, "u", "x" * 999), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 90)]
    return out + [(100 + i, "hot", same) for i in range(40)]


@pytest.mark.parametrize("chunk", [64, 1 << 18])
def test_archives_read_back(spark, rows, chunk):
    manifest = warc.write_archives(pages(spark, rows).repartition(3), chunk=chunk)
    got = warc.index(warc.read_archives(manifest, chunk=chunk)).collect()
    assert {tuple(r) for r in got} == expected(rows) and len(got) == len(rows)


def test_chunks_carry_digests_and_bytes(spark, rows):
    manifest = warc.write_archives(pages(spark, rows), chunk=1000)
    by = {}
    for r in warc.read_archives(manifest, chunk=1000).collect():
        by.setdefault(r.page_id, []).append(r)
    html = {i: (h or "").encode() for i, _, h in rows}
    for i, cs in by.items():
        cs.sort(key=lambda r: r.chunk_no)
        assert max(len(c.data) for c in cs) <= 1000
        done = b""
        for c in cs:
            done += c.data
            assert c.running_sha1 == hashlib.sha1(done).hexdigest() and c.n_bytes == len(done)
        assert done == (b"" if cs[0].record_type == "revisit" else html[i])


def test_files_are_gzip_members_of_warc_records(spark, rows):
    from quarry.llm.arrays import store_of
    manifest = warc.write_archives(pages(spark, rows)).collect()
    text = b""
    for r in manifest:
        store, at = store_of(r.path)
        with store.open_input_stream(at, compression=None) as f:
            text += gzip.decompress(f.read())
    assert text.count(b"WARC-Record-ID: ") == len(rows)
    assert sum(r.records for r in manifest) == len(rows)


def test_odd_tables(spark):
    def run(rows):
        df = pages(spark, rows) if rows else pages(spark, [(1, "", "")]).limit(0)
        return sorted(tuple(r) for r in warc.index(warc.read_archives(warc.write_archives(df))).collect())
    assert run([]) == []
    assert run([(None, "u", "x" * 2000)]) == []
    copies = run([(1, "u", "x" * 2000), (1, "u", "x" * 2000), (2, "u", "y")])
    assert [r[0] for r in copies] == [1, 2] and copies[0][3] == "response"
    two = run([(1, "u", "x" * 2000), (1, "u", "y" * 2000)])
    assert len(two) == 1
