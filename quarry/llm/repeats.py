"""Repeated sentences, lines or paragraphs across a corpus.

A text falls into units: sentences, lines, or paragraphs between blank lines.
A sentence ends with its line or with a run of . ! ?; one of more than ``LONG``
words is cut once more, after each word whose MD5 digest begins with a 0 or a
1, so that text without punctuation has units too, and the same ones wherever a
passage begins.  A unit is normalised (A-Z lower-cased, white space runs to one
space, trimmed).

What is hashed is a unit joined with as many of its followers as ``min_words``
words take (``min_words=1``: the unit alone).  A passage that begins and ends
inside lines is caught from its first whole unit on, and a sentence that merely
recurs ("Yes.") is left alone, being part of no joined unit that recurs.  MD5
digests are grouped over the whole corpus; of equal joined units the occurrence
of smallest (id, unit number) is kept, and every later one that does not overlap
it is removed.  Offsets of the original text go with every removed unit.

Digests of very many rows, found on a sixteenth of the rows by hash, are
grouped with a combine before the shuffle and looked up by broadcast; the others
are shuffled once, few rows to a digest.  Which way a digest goes changes nothing
in the result.

Defined results: null and empty texts have no units, blank units do not count;
the last units of a text, short of ``min_words`` words, are hashed only as
followers; long texts are read whole, some thousands of units at a time; of rows
that repeat an id the unit numbers coincide, so the later copies of a unit are
told apart by nothing and only units that also occur under a smaller (id, unit
number) are repeats; rows with a null id rank last, as id 2^63 - 1; an empty
table gives no rows; other columns are ignored by ``repeated_units`` and kept by
``remove``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_name, staged

# of the UTF-8 form: what a unit is made of, or what stands between two
_PIECE = {"line": re.compile(rb"[^\n]+"), "sentence": re.compile(rb"[^.!?\n]+")}
_GAP = re.compile(rb"\n[\x20\t\r\x0b\x0c]*\n[\x20\x09-\x0D]*")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_JOINED = "doc_id long, unit_no int, h1 long, h2 long, start long, end long, n_words int"
_HELD = 20_000   # units of a text in memory at a time
LONG = 16        # words of a sentence that is not cut


def pieces(low: bytes, unit: str) -> Iterator[tuple[int, int]]:
    """(start, end) between the separators, in bytes."""
    if unit != "paragraph":
        for m in _PIECE[unit].finditer(low):
            yield m.span()
        return
    at = 0
    for m in _GAP.finditer(low):
        yield at, m.start()
        at = m.end()
    yield at, len(low)


@lru_cache(100_000)
def _is_cut(word: bytes) -> bool:
    return hashlib.md5(word).digest()[0] < 0x20


def units(low: bytes, unit: str) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, normalised text) of the units that hold words, in
    bytes.  Lines and paragraphs span all between their separators, sentences
    their words only."""
    for s, e in pieces(low, unit):
        piece = low[s:e]
        words = piece.split()
        if not words:
            continue
        if unit != "sentence":
            yield s, e, len(words), b" ".join(words)
        elif len(words) <= LONG:
            yield s + len(piece) - len(piece.lstrip()), s + len(piece.rstrip()), len(words), b" ".join(words)
        else:
            spans = [m.span() for m in _WORD.finditer(piece)]
            first = 0
            for i, w in enumerate(words):
                if i + 1 == len(words) or _is_cut(w):
                    yield s + spans[first][0], s + spans[i][1], i + 1 - first, b" ".join(words[first:i + 1])
                    first = i + 1


def joined_units(low: bytes, unit: str, min_words: int) -> Iterator[tuple[int, list, list, list, list]]:
    """Runs of joined units: (number of the first, digests, starts, ends, words)."""
    starts, ends, counts, keys = [], [], [], []
    no = 0

    def joined():
        """The joined units that are complete."""
        digests, last, words = [], [], []
        j = have = 0
        for i, n in enumerate(counts):
            while have < min_words and j < len(counts):
                have += counts[j]
                j += 1
            if have < min_words:
                break
            digests.append(hashlib.md5(keys[i] if j == i + 1 else b" ".join(keys[i:j])).digest())
            last.append(ends[j - 1])
            words.append(have)
            have -= n
        return digests, last, words

    for s, e, n, key in units(low, unit):
        starts.append(s)
        ends.append(e)
        counts.append(n)
        keys.append(key)
        if len(keys) >= _HELD:
            digests, last, words = joined()
            yield no, digests, starts[:len(digests)], last, words
            no += len(digests)
            for held in (starts, ends, counts, keys):
                del held[:len(digests)]
    digests, last, words = joined()
    yield no, digests, starts[:len(digests)], last, words


def _code_points(text: str, utf8: bytes, at: list) -> np.ndarray:
    """Byte offsets as code-point offsets."""
    at = np.asarray(at, np.int64)
    if len(utf8) == len(text):
        return at
    begins = (np.frombuffer(utf8, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])[at]


def _digests(unit: str, min_words: int):
    names = [c.split()[0] for c in _JOINED.split(", ")]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in names]

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(cols, types)], names=names)
            for c in cols:
                c.clear()
            return out

        held = 0
        for b in batches:
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py()
                if not text:
                    continue
                utf8 = text.encode("utf-8", "surrogatepass")
                for no, digests, starts, ends, words in joined_units(utf8.translate(_LOWER), unit, min_words):
                    n = len(digests)
                    if not n:
                        continue
                    h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(n, 2)
                    for c, x in zip(cols, (np.full(n, doc_id, np.int64), np.arange(no, no + n), h[:, 0], h[:, 1],
                                           _code_points(text, utf8, starts), _code_points(text, utf8, ends), np.asarray(words))):
                        c.append(x)
                    held += n
                    if held >= 4 * _HELD:
                        yield flush()
                        held = 0
        if held:
            yield flush()
    return run


def _hot_digests(every: DataFrame) -> DataFrame:
    """The digests of many rows: at most 2.1 times ``BROADCAST_ROWS``."""
    limit = max(96, -(-every.count() // BROADCAST_ROWS))
    some = every.filter(F.pmod(F.xxhash64("doc_id", "unit_no"), F.lit(16)) == 0)
    counts = some.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return staged(counts.filter(F.col("n") >= limit // 32).select("h1", "h2"), "hot-digests")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                   unit: str = "sentence", min_words: int = 20) -> DataFrame:
    """One row per later occurrence of a joined unit: doc_id, unit_no (its first
    unit, counted from 0), start, end, n_words, digest, kept_doc_id,
    kept_unit_no.  Joined units of one text may overlap each other."""
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2 ** 63 - 1)).alias("doc_id"),
                      F.col(text_col).cast("string").alias("text"))
    every = staged(src.mapInArrow(_digests(unit, min_words), _JOINED), "units")
    hot = F.broadcast(_hot_digests(every))
    first = every.join(hot, ["h1", "h2"]).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "unit_no", "end")).alias("k"))
    first = staged(first.select("h1", "h2", F.col("k.doc_id").alias("kept_doc_id"), F.col("k.unit_no").alias("kept_unit_no"),
                                F.col("k.end").alias("kept_end")), "hot-kept")
    by_digest = Window.partitionBy("h1", "h2").orderBy("doc_id", "unit_no")
    cold = every.join(hot, ["h1", "h2"], "left_anti").select(
        "*", *[F.first(c).over(by_digest).alias(f"kept_{c}") for c in ("doc_id", "unit_no", "end")])
    both = every.join(F.broadcast(first), ["h1", "h2"]).unionByName(cold)
    same_text = F.col("doc_id") == F.col("kept_doc_id")
    later = both.filter(~(same_text & ((F.col("unit_no") == F.col("kept_unit_no")) | (F.col("start") < F.col("kept_end")))))
    digest = F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in ("h1", "h2")])
    return later.select("doc_id", "unit_no", "start", "end", "n_words", digest.alias("digest"), "kept_doc_id", "kept_unit_no")


def cut(text: str, starts: list[int], ends: list[int]) -> str:
    """``text`` without the given spans.  A sentence's marks and the space after
    them go with it; a line end goes with a span that its line began with."""
    merged: list[list[int]] = []
    for s, e in sorted(zip(starts, ends)):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    out, at, n = [], 0, len(text)
    for s, e in merged:
        if s > at:
            out.append(text[at:s])
        begins = s == 0 or text[s - 1] == "\n"
        while e < n and text[e] in ".!?":
            e += 1
        if e < n and (text[e] == " " or text[e] == "\n" and begins):
            e += 1
        at = e
    return "".join(out) + text[at:]


def remove(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated units cut out of their texts; all rows and
    columns stay, texts without repeats unchanged."""
    spans = repeats.groupBy("doc_id").agg(F.collect_list("start").alias("s"), F.collect_list("end").alias("e")) \
        .select(F.col("doc_id").alias(free_name(docs, "repeats_of")), F.struct("s", "e").alias(free_name(docs, "spans")))
    key = F.coalesce(docs[id_col].cast("long"), F.lit(2 ** 63 - 1))
    joined = docs.join(spans, key == spans[spans.columns[0]], "left").drop(spans.columns[0])
    names = docs.columns
    at, last = names.index(text_col), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None or s is None else cut(t, s["s"], s["e"])
                     for t, s in zip(b.column(at).to_pylist(), b.column(last).to_pylist())]
            arrays = [pa.array(texts, b.schema.field(at).type) if i == at else b.column(i) for i in range(last)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.mapInArrow(run, docs.schema)
