"""WARC archives through a chunked record table.

A payload never travels as one value: it is a set of rows (record id, chunk
number, bytes) of at most ``chunk`` bytes, in order, and whoever reads them in
order carries the digest along, so every chunk row also holds the digest of
the payload up to its end.  Writing: rows of a record stream into a gzip
member of the task's archive.  Reading: the archive streams through fixed
buffers and comes out as chunk rows again, whatever the size of a record.

Of records with equal payloads of at least ``revisit_bytes`` bytes the one
with the largest id is written as ``response``; the others are ``revisit``
records without a payload that refer to it.  A task writes its archive under a
name of its own and reports it in a manifest table; files of failed attempts
are never in the manifest, so a lost executor changes nothing.

Defined results: a null payload is an empty one; a null url is written as an
empty target; rows that share an id are written each, and
the index keeps the one with the greatest digest; rows with a null id are left out, for no record can be named after
it; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .arrays import store_of
from .common import bounded, staged, unique_name

CRLF = b"\r\n"
_MANIFEST = "path string, records long, bytes long"
_CHUNKS = ("page_id long, chunk_no long, data binary, n_bytes long, running_sha1 string, "
           "record_type string, refers_to long, declared_sha1 string")


def record_id(page_id: int) -> str:
    return f"<urn:quarry:page:{page_id}>"


def _page_of(rid: str) -> int:
    return int(rid.rstrip(">").rsplit(":", 1)[1])


def decisions(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """page_id, url, payload (binary), payload_bytes, sha1, refers_to."""
    one = pages.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # thin rows per distinct payload; combined before the shuffle, so a payload
    # that a third of the pages share costs one row per task
    last = (one.filter(F.col("payload_bytes") >= revisit_bytes).groupBy("sha1", "payload_bytes")
            .agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
            .filter("_n > 1").drop("_n"))
    last = bounded(staged(last, "shared-payloads"))
    return (one.join(last, ["sha1", "payload_bytes"], "left")
            .withColumn("refers_to", F.when(F.col("_last") != F.col("page_id"), F.col("_last"))).drop("_last"))


def chunk_rows(records: DataFrame, chunk: int) -> DataFrame:
    """Record table -> rows (page_id, chunk_no, data, ...); a record without a
    payload, and a revisit, has one empty chunk."""
    size = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(F.lit(0))
    last = F.greatest(F.lit(1), F.ceil(size / chunk)).cast("int") - 1
    no = records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    data = F.when(F.col("refers_to").isNull(),
                  F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit("").cast("binary"))
    return no.select("page_id", "chunk_no", "url", "payload_bytes", "sha1", "refers_to", data.alias("data"))


def _header(r: dict) -> bytes:
    revisit = r["refers_to"] is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_id(r['page_id'])}", "WARC-Date: 1970-01-01T00:00:00Z",
            "WARC-Target-URI: " + "".join((r["url"] or "").splitlines()),
            f"WARC-Payload-Digest: sha1:{r['sha1']}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(r['refers_to'])}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else r['payload_bytes']}"]
    return "\r\n".join(head).encode() + CRLF + CRLF


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = gz = None
        records = total = 0
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    path = f"{folder}/{unique_name('part')}.warc.gz"
                    store, at = store_of(path)
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(at, compression=None)
                if r["chunk_no"] == 0:
                    if gz is not None:
                        out.write(gz.compress(CRLF + CRLF) + gz.flush())
                    gz = zlib.compressobj(6, zlib.DEFLATED, 31)  # one gzip member per record
                    out.write(gz.compress(_header(r)))
                    records += 1
                out.write(gz.compress(r["data"]))
                total += len(r["data"])
        if out is not None:
            out.write(gz.compress(CRLF + CRLF) + gz.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records]), pa.array([total])],
                                             names=["path", "records", "bytes"])
    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *,
                   revisit_bytes: int = 1000, chunk: int = 1 << 18, folder: str | None = None) -> DataFrame:
    """Write one record per page; returns the manifest (path, records, bytes)."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "llm-warc")
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = chunk_rows(decisions(src.filter("page_id is not null"), revisit_bytes), chunk)
    # the chunks of a record come out of one row, so they stand in order
    return staged(rows.mapInArrow(_write(folder), _MANIFEST), "warc-manifest")


class _Members:
    """Bytes of consecutive gzip members through a fixed buffer."""

    def __init__(self, stream, buffer: int):
        self.stream, self.buffer = stream, buffer
        self.z, self.raw, self.data = zlib.decompressobj(31), b"", b""

    def fill(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.buffer)
                if not self.raw:
                    return False
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(self.raw, self.buffer)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                self.data += got
                return True

    def head(self) -> bytes | None:
        """A record's header, without the blank line; None at the end."""
        while True:
            self.data = self.data.lstrip(CRLF)
            if self.data or not self.fill():
                break
        while (end := self.data.find(CRLF + CRLF)) < 0:
            if not self.fill():
                return None
        head, self.data = self.data[:end], self.data[end + 4:]
        return head

    def read(self, most: int) -> bytes:
        while len(self.data) < most and self.fill():
            pass
        got, self.data = self.data[:most], self.data[most:]
        return got


def records_of(stream, chunk: int) -> Iterator[tuple]:
    """Chunk rows of an archive, in order: (page_id, chunk_no, data, bytes so
    far, digest so far, type, refers_to, digest the header states)."""
    src = _Members(stream, min(chunk, 1 << 16))
    while (head := src.head()) is not None:
        f = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        left, no, digest, done = int(f["Content-Length"]), 0, hashlib.sha1(), 0
        ref = _page_of(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None
        stated = f["WARC-Payload-Digest"].removeprefix("sha1:")
        while no == 0 or left:
            data = src.read(min(chunk, left))
            if left and not data:
                raise EOFError(f"archive ends inside {f['WARC-Record-ID']}")
            digest.update(data)
            left -= len(data)
            done += len(data)
            yield (_page_of(f["WARC-Record-ID"]), no, data, done, digest.hexdigest(),
                   f["WARC-Type"], ref, stated)
            no += 1


def _read(chunk: int, with_data: bool):
    names = [c.split()[0] for c in _CHUNKS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = store_of(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for r in records_of(stream, chunk):
                        rows.append(r if with_data else (*r[:2], None, *r[3:]))
                        held += len(r[2]) if with_data else 256
                        if held > 1 << 22:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)
    return run


def read_archives(manifest: DataFrame, *, chunk: int = 1 << 18, with_data: bool = True) -> DataFrame:
    """The chunk rows of the archives a manifest lists, one archive per task
    and step; ``with_data`` False leaves the bytes out after digesting them."""
    files = manifest.select("path")
    spread = files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4), "path")
    return spread.mapInArrow(_read(chunk, with_data), _CHUNKS)


def index(chunks: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type,
    refers_to.  A revisit has the size and digest of the record it refers to;
    a digest that differs from the one its header states fails the job."""
    last = (chunks.groupBy("page_id", "declared_sha1").agg(
        F.max_by(F.struct("n_bytes", "running_sha1", "record_type", "refers_to"), "chunk_no").alias("r"))
        .select("page_id", "declared_sha1", "r.*"))
    last = staged(last, "warc-index")
    said = last.filter("refers_to is null").select(
        F.col("page_id").alias("refers_to"), "declared_sha1",
        F.col("n_bytes").alias("_n"), F.col("running_sha1").alias("_d"))
    every = last.join(said, ["refers_to", "declared_sha1"], "left")
    own = F.col("refers_to").isNull()
    digest = F.when(own, F.col("running_sha1")).otherwise(F.col("_d"))
    checked = F.when(digest.eqNullSafe(F.col("declared_sha1")), digest).otherwise(
        F.raise_error(F.concat(F.lit("payload digest differs: page "), F.col("page_id").cast("string"))))
    rows = every.select("page_id", F.when(own, F.col("n_bytes")).otherwise(F.col("_n")).alias("payload_bytes"),
                        checked.cast("string").alias("payload_digest"), "record_type", "refers_to")
    fields = rows.columns[1:]
    return rows.groupBy("page_id").agg(F.max_by(F.struct(*fields), "payload_digest").alias("r")).select("page_id", "r.*")
