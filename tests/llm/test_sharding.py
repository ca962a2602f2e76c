import math
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import queries, sharding
from quarry.llm.sharding import Shard, Tree

from .conftest import DOCS, frame


def plain_shard(key, tree):
    """The definition, node by node, with all weights summed anew."""
    seed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42)

    def draw(name, weight):
        h = xxhash.xxh64_intdigest(name.encode(), seed=seed) >> 12
        return -math.log((h + 0.5) / 2 ** 52) / weight

    here, path = list(tree.shards), ""
    for level in (lambda s: s.region, lambda s: s.rack, lambda s: str(s.shard)):
        kids = defaultdict(list)
        for s in here:
            kids[level(s)].append(s)
        weigh = {name: sum(s.weight for s in ss) for name, ss in kids.items()}
        name = min((name for name in kids if weigh[name] > 0), key=lambda name: draw(path + name, weigh[name]))
        here, path = kids[name], path + name + "/"
    return here[0].shard


UNEVEN = Tree((Shard(0, "a", "x", 2.0), Shard(1, "a", "x", 0.5), Shard(2, "a", "y", 1.0), Shard(3, "b", "x", 4.0),
               Shard(7, "b", "z", 0.0), Shard(9, "c", "x", 0.25)))


@pytest.mark.parametrize("tree", [sharding.uniform(40), sharding.uniform(3), UNEVEN, UNEVEN.grown(3.0)])
def test_shards_equal_the_definition(spark, tree):
    keys = [None, 0, -1, 2 ** 62, -2 ** 63] + list(range(7, 900, 3))
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    got = {r[0]: r[1] for r in df.select("doc_id", sharding.shard_of(F.col("doc_id"), tree)).collect()}
    assert got == {k: plain_shard(k, tree) for k in keys}


def test_odd_rows(spark, odd_rows):
    df = frame(spark, odd_rows).repartition(3)
    got = sharding.assign(df, sharding.uniform(40)).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "key" and r.shard == plain_shard(r.doc_id, sharding.uniform(40))
        assert r.grown_shard in (r.shard, 40) and r.grown_shard == plain_shard(r.doc_id, sharding.uniform(40).grown())
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(spark.createDataFrame([], DOCS), sharding.uniform(40)).collect() == []


def _path(tree, shard):
    s = next(s for s in tree.shards if s.shard == shard)
    return [(s.region,), (s.region, s.rack), (s.region, s.rack, s.shard)]


def _weights(tree):
    w = Counter()
    for s in tree.shards:
        for node in _path(tree, s.shard):
            w[node] += s.weight
    return w


@pytest.mark.parametrize("change", [{5: 2.0}, {5: 0.25, 6: 1.75}, {0: 0.0}, {3: 0.5, 30: 3.0}])
def test_movement_stays_where_weights_change(spark, change):
    before = sharding.uniform(40)
    after = before.reweighted(change)
    w0, w1 = _weights(before), _weights(after)
    rows = sharding.moves(spark.range(20_000).withColumnRenamed("id", "doc_id"), before, after).collect()
    assert rows
    for r in rows:
        old, new = next((a, b) for a, b in zip(_path(before, r.shard_before), _path(after, r.shard_after)) if a != b)
        # where the paths part, one of the two children changed, towards the new one
        assert w1[new] > w0[new] or w1[old] < w0[old]


def test_growth_takes_only_its_share(spark):
    before = sharding.uniform(40)
    n = 40_000
    rows = sharding.moves(spark.range(n).withColumnRenamed("id", "doc_id"), before, before.grown()).collect()
    assert {r.shard_after for r in rows} == {40}
    assert abs(sum(r.n for r in rows) - n / 41) < 6 * math.sqrt(n / 41)
    twice = before.grown().grown()
    assert {r.shard_after for r in sharding.moves(spark.range(n).withColumnRenamed("id", "doc_id"), before.grown(), twice)
            .collect()} == {41}


def test_shares_follow_weights(spark):
    n = 40_000
    got = {r[0]: r[1] for r in spark.range(n).select(sharding.shard_of(F.col("id"), UNEVEN).alias("s")).groupBy("s").count().collect()}
    total = sum(s.weight for s in UNEVEN.shards)
    for s in UNEVEN.shards:
        want = n * s.weight / total
        assert abs(got.get(s.shard, 0) - want) <= 6 * math.sqrt(want)


def test_written_shards_hold_every_row(spark, odd_rows, tmp_path):
    df = frame(spark, odd_rows).withColumn("shard", F.lit("own column"))
    sharding.write_shards(df, sharding.uniform(5), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*df.columns, "shard_"}
    rows = back.select("doc_id", "text", "shard", "shard_").collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(odd_rows)
    assert all(r.shard == "own column" and r.shard_ == plain_shard(r.doc_id, sharding.uniform(5)) for r in rows)


def test_bad_trees():
    for shards in ((), (Shard(0, "a", "x"), Shard(0, "b", "x")), (Shard(0, "a", "x", -1.0),), (Shard(0, "a", "x", 0.0),)):
        with pytest.raises(ValueError):
            Tree(tuple(shards))


def test_query(spark):
    got = queries.QUERIES["op11_sharding"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard) for r in got) == Counter(
        (d.doc_id, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode()),
         plain_shard(d.doc_id, sharding.uniform(40))) for d in docs)
