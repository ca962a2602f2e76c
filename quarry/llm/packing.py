"""Bounded-space online packing of token sequences.

Each task reads its documents in order, encodes them and keeps at most
``open_windows`` unfinished windows.  What a document has left after its whole
windows goes to the open window where it fits best; when it fits in none, the
fullest window is closed by cutting as much from the piece as it has room for,
so a closed window holds exactly ``window`` ids.  What stays open at the end of
the tasks (at most ``open_windows`` windows each) is merged: the leftovers are
laid end to end by prefix sums over the tasks and cut anew, still in parallel.

Defined results: null and empty texts have the end id alone; repeated rows and
ids are packed row by row; an empty table gives no rows; columns other than the
id and the text are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import lean
from .common import staged

END_ID = 1
# Up to here the two byte-level BPE libraries classify every character alike
# (tests/llm checks all of them); any other text goes to ``tokenizers`` itself.
_BEYOND = re.compile("[^\x00-ɏ]")

_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("part", pa.int64()), ("at", pa.int64()), ("ids", pa.binary())])
_DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, part long, at long, ids binary")


class Encoder:
    """Ids of a byte-level BPE vocabulary.  ``ranks_path`` names the same
    vocabulary as ranks, which encodes several times faster."""

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer
        self._exact = Tokenizer.from_file(path)
        self._exact.encode_special_tokens = True  # their strings in a text are ordinary text
        self._fast = None
        if ranks_path:
            import tiktoken
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                                           special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self._fast is not None and not _BEYOND.search(text):
            return self._fast.encode_ordinary(text)
        return self._exact.encode(text, add_special_tokens=False).ids


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class _Windows:
    """The open windows of one task and the rows it has ready."""

    def __init__(self, window: int, most: int, part: int):
        self.window, self.most, self.part = window, most, part
        self.open: list[list] = []  # [ids so far, [(doc_id, start, ids, doc_tokens)]]
        self.closed, self.rows = 0, []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, pos = len(ids), 0
        while pos < n:
            left = n - pos
            if left >= self.window:
                self._close([(doc_id, pos, ids[pos:pos + self.window], n)])
                pos += self.window
                continue
            fits = [w for w in self.open if w[0] + left <= self.window]
            if fits:
                w = max(fits, key=lambda x: x[0])
            elif len(self.open) < self.most:
                w = [0, []]
                self.open.append(w)
            else:
                w = max(self.open, key=lambda x: x[0])
            take = min(left, self.window - w[0])
            w[1].append((doc_id, pos, ids[pos:pos + take], n))
            w[0] += take
            pos += take
            if w[0] == self.window:
                # identity, not equality: two open windows can look alike
                self.open = [x for x in self.open if x is not w]
                self._close(w[1])

    def _close(self, pieces: list) -> None:
        seq, at = (self.part << 32) + self.closed, 0
        self.closed += 1
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), crc(ids), n, seq, at, self.part, None, None))
            at += len(ids)

    def leftovers(self) -> None:
        at = 0
        for _, pieces in self.open:
            for doc_id, start, ids, n in pieces:
                self.rows.append((doc_id, start, len(ids), None, n, None, None, self.part, at,
                                  ids.astype("<u4").tobytes()))
                at += len(ids)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = list(zip(*rows)) or [[] for _ in _PIECES]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECES)],
                                          schema=_PIECES)


def _pack_partition(window: int, most: int, key: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(*key)  # of this task: waiting workers do not hold its tables
        packer = _Windows(window, most, TaskContext.get().partitionId())
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.ids(text.as_py() or "")
                ids.append(END_ID)
                packer.add(doc_id, np.asarray(ids, dtype=np.uint32))
                if len(packer.rows) >= 10_000:
                    yield packer.take()
        packer.leftovers()
        yield packer.take()
    return run


def cut_points(total: int, window: int) -> list[int]:
    """Starts of the sequences after the last whole window: the rest is cut
    into descending powers of two, which need no padding."""
    at, out = total - total % window, []
    for bit in range(window.bit_length(), -1, -1):
        if (total % window) >> bit & 1:
            out.append(at)
            at += 1 << bit
    return out


def _merge(total: int, window: int, first_seq: int):
    tail = np.asarray(cut_points(total, window) + [total], dtype=np.int64)
    whole = total // window

    def bounds(pos: int) -> tuple[int, int, int]:
        """(sequence number, its start, its end) at a position."""
        if pos < whole * window:
            s = pos // window
            return s, s * window, (s + 1) * window
        i = int(np.searchsorted(tail, pos, side="right")) - 1
        return whole + i, int(tail[i]), int(tail[i + 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                ids, done = np.frombuffer(r["ids"], dtype="<u4"), 0
                while done < len(ids):
                    s, lo, hi = bounds(r["pos"] + done)
                    off = r["pos"] + done - lo
                    piece = ids[done:done + hi - lo - off]
                    rows.append((r["doc_id"], r["start"] + done, len(piece), crc(piece),
                                 r["doc_tokens"], first_seq + s, off))
                    done += len(piece)
            cols = list(zip(*rows)) or [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols], names=_PIECES.names[:7])
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
         tokenizer: str, ranks: str | None = None, pattern: str | None = None,
         window: int = 2048, open_windows: int = 16) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  Every id of every document is in exactly one piece.

    ``sequence_id`` is (task number << 32) + count for windows closed by a
    task and starts at 1 << 62 for merged leftovers.  All sequences hold
    ``window`` ids but the last merged ones, whose lengths are powers of two.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).cast("string").alias("text"))
    key = (tokenizer, ranks, pattern)
    pieces = staged(src.mapInArrow(lean(_pack_partition(window, open_windows, key)), _DDL), "pieces")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    done = pieces.filter("ids is null").select(out)
    left = pieces.filter("ids is not null")
    sizes = left.groupBy("part").agg(F.sum("length").alias("n"))  # one row per task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    merged = (left.join(base, "part")
              .select("doc_id", "start", "doc_tokens", (F.col("base") + F.col("at")).alias("pos"), "ids")
              .mapInArrow(lean(_merge(total, window, 1 << 62)),
                          "doc_id long, start long, length long, ids_crc32 long, "
                          "doc_tokens long, sequence_id long, offset long"))
    return done.unionByName(merged)
