"""Interpolated modified Kneser-Ney bigram model.

Counting: (1) word counts, grouped by hash, give the vocabulary; a word's
number is its place in the sorted hashes.  (2) Pairs (previous word, word) are
counted under the key previous << 32 | word.  Tasks count in arrays, send
packed blocks to the shard of a key and merge them there.  From a shard's pairs
come, per previous word, the total and the numbers of followers seen once,
twice and more often, and per word the number of different words before it;
these are summed over the shards.  Everything is stored as sorted arrays that
scoring workers map (``arrays``); the driver holds names of files and the
counts of counts.

Scoring, with D1, D2, D3+ from the counts of counts of each order:

    p(w | v) = max(c(v w) - D(c), 0) / c(v .) + g(v) * p(w)
    p(w)     = max(n(. w) - D'(n), 0) / n(. .) + g' / (V + 1)

A previous word that is never one in training leaves p(w); an unknown word has
the uniform share.  A text is its words and one end; the first word follows a
start that is no word.

Defined results: null and empty texts are one end; repeated rows count once
each; without training texts every probability is 1 (log 0); rows with a null
id are scored, and learnt from as ``fold`` says; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import arrays, tokens
from .common import staged

END = np.uint64(0xE7D0E7D0E7D0E7D1)  # the end's key among the words' hashes
_ESCAPE = 255


@dataclass(frozen=True)
class Discounts:
    """Modified Kneser-Ney discounts of one order."""
    d: tuple

    @staticmethod
    def of(n: list[int]) -> Discounts:
        """From the numbers of n-grams seen 1, 2, 3 and 4 times.  Where a
        number is 0 the estimate does not exist and k / 2 stands in."""
        n1, n2, n3, n4 = (float(x) for x in n)
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        raw = [k - (k + 1) * y * b / a if a and b else k / 2
               for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
        return Discounts((0.0, *(min(max(x, 0.0), float(k)) for k, x in enumerate(raw, 1))))

    def at(self, c: np.ndarray) -> np.ndarray:
        return np.asarray(self.d)[np.minimum(c, 3).astype(np.int64)]


@dataclass(frozen=True)
class Model:
    """Names of the shards and the few numbers that scoring needs."""
    vocab: arrays.Listing   # paths: keys, counts
    first: arrays.Listing   # number of each vocabulary shard's first word, and V at the end
    words: arrays.Listing   # paths: total, n1, n2, n3, before (same split as vocab)
    pairs: arrays.Listing   # paths: keys, low, over_at, over (None: an empty shard)
    n_tokens: int
    n_words: int
    pair_types: int
    pair_discounts: Discounts
    word_discounts: Discounts
    word_n: tuple     # numbers of words with 1, 2 and more different words before

    @property
    def start(self) -> int:
        return self.n_words

    @property
    def rest(self) -> float:
        """The uniform share of p(w)."""
        if not self.pair_types:
            return 1.0
        return sum(d * n for d, n in zip(self.word_discounts.d[1:], self.word_n)) / self.pair_types


# --- counting -----------------------------------------------------------------

def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, docs = arrays.Tally(), 0

        def flush():
            keys, counts = tally.take()
            return arrays.blocks(keys, counts, arrays.shard_of(keys, shards))

        for whole in batches:
            for b in arrays.slices(whole, 0):
                h, _ = tokens.word_hashes(b.column(0))
                tally.add(h)
                docs += b.num_rows
                if tally.full():
                    yield from flush()
        if docs:
            tally.parts.append((np.asarray([END]), np.asarray([docs], np.uint32)))
            yield from flush()
    return run


def _merge_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, keys, counts in arrays.by_shard(batches):
            path = arrays.write_shard(folder, {"keys": keys, "counts": counts})
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int32()), pa.array([path]), pa.array([len(keys)], pa.int64()),
                 pa.array([int(counts.sum())], pa.int64())], names=["shard", "path", "n", "total"])
    return run


def lookup_words(model: Model, h: np.ndarray) -> np.ndarray:
    """Numbers of sorted distinct hashes; -1 for unknown words."""
    out = np.full(len(h), -1, np.int64)
    sid = arrays.shard_of(h, len(model.vocab))
    for s in np.unique(sid):
        if model.vocab[s] is None:
            continue
        a, b = np.searchsorted(sid, [s, s + 1])
        keys = arrays.shard(model.vocab[s])["keys"]
        at = np.searchsorted(keys, h[a:b])
        at_c = np.minimum(at, len(keys) - 1)
        out[a:b] = np.where(keys[at_c] == h[a:b], at_c + model.first[s], -1)
    return out


def _numbered(model: Model, b: pa.RecordBatch, text: int):
    """(distinct hashes, their numbers, index of every word among them, number
    of words of each text)."""
    h, n = tokens.word_hashes(b.column(text))
    u = tokens.distinct(h)
    return u, lookup_words(model, u), np.searchsorted(u, h), n


def _sequences(of_word: np.ndarray, n: np.ndarray, end, start) -> tuple[np.ndarray, np.ndarray]:
    """(previous, current) values over the words and one end of each text."""
    ends = np.cumsum(n + 1) - 1
    cur = np.empty(len(of_word) + len(n), of_word.dtype)
    mask = np.ones(len(cur), bool)
    mask[ends] = False
    cur[mask] = of_word
    cur[ends] = end
    prev = np.empty_like(cur)
    prev[1:] = cur[:-1]
    prev[ends - n] = start
    return prev, cur


def _pair_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return arrays.shard_of(tokens.mix(keys), shards)


def _count_pairs(model: Model, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = arrays.Tally()

        def flush():
            keys, counts = tally.take()
            return arrays.blocks(keys, counts, _pair_shard(keys, shards))

        end = int(lookup_words(model, np.asarray([END]))[0])
        for whole in batches:
            for b in arrays.slices(whole, 0):
                _, ids, at, n = _numbered(model, b, 0)
                prev, cur = _sequences(ids[at], n, end, model.start)
                tally.add((prev.astype(np.uint64) << np.uint64(32)) | cur.astype(np.uint64))
                if tally.full():
                    yield from flush()
        yield from flush()
    return run


def _word_blocks(model: Model, ids: np.ndarray, values: np.ndarray, kind: int):
    """Rows (vocabulary shard, kind, numbers, values) of a statistic."""
    sid = np.clip(np.searchsorted(model.first.array(), ids, side="right") - 1, 0, len(model.vocab) - 1)
    at = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1]))) if len(sid) else []
    return [(int(sid[a]), kind, arrays.planes(arrays.delta(ids[a:b].astype(np.uint64))),
             arrays.planes(values[a:b].astype(np.uint64))) for a, b in zip(at, np.append(at[1:], len(sid)))]


_STATS = ("total", "n1", "n2", "n3", "before")
_MERGED_DDL = ("shard int, kind int, path string, types long, n1 long, n2 long, n3 long, n4 long, "
               "ids binary, vals binary")
_MERGED = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("path", pa.string()), ("types", pa.int64()),
                     *((f"n{k}", pa.int64()) for k in range(1, 5)), ("ids", pa.binary()), ("vals", pa.binary())])


def _counts_of(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in range(1, 5)]


def _merge_pairs(model: Model, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MERGED)], schema=_MERGED)

        for s, keys, counts in arrays.by_shard(batches):
            big = np.flatnonzero(counts >= _ESCAPE)
            path = arrays.write_shard(folder, {
                "keys": keys, "low": np.minimum(counts, _ESCAPE).astype(np.uint8),
                "over_at": big.astype(np.uint32), "over": counts[big]})
            rows = [(s, -1, path, len(keys), *_counts_of(counts), None, None)]
            prev = keys >> np.uint64(32)
            at, _ = tokens.runs(prev)
            stats = [np.add.reduceat(v.astype(np.uint64), at) for v in
                     (counts, counts == 1, counts == 2, counts >= 3)]
            blocks = [r for k, v in enumerate(stats) for r in _word_blocks(model, prev[at], v, k)]
            cur = np.sort(keys & np.uint64(0xFFFFFFFF))
            at, n = tokens.runs(cur)
            blocks += _word_blocks(model, cur[at], n, 4)
            yield out(rows + [(v, k, None, None, None, None, None, None, i, x) for v, k, i, x in blocks])
    return run


def _merge_stats(model: Model, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(4))):
                s, kind, ids, vals = r
                lo = model.first[s]
                hi = model.first[s + 1] + (s == len(model.vocab) - 1)  # the start, after the last word
                got = sums.setdefault(s, np.zeros((5, hi - lo), np.uint64))
                got[kind][arrays.undelta(arrays.unplanes(ids, np.uint64)).astype(np.int64) - lo] += \
                    arrays.unplanes(vals, np.uint64)
        for s, got in sums.items():
            path = arrays.write_shard(folder, {k: v.astype(np.uint64 if k == "total" else np.uint32)
                                               for k, v in zip(_STATS, got)})
            before = got[4]
            n = [*_counts_of(before), int((before >= 3).sum())]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([path]), pa.array([n], pa.list_(pa.int64()))],
                                             names=["shard", "path", "n"])
    return run


def train(docs: DataFrame, text_col: str = "text", *, shard_bytes: int = 1 << 23) -> Model:
    """Count a model over every row of ``docs``.  ``shard_bytes``: text per
    shard, so a merging task's memory does not grow with the corpus."""
    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = src.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    folder = scratch_path(spark, "llm-lm")

    words = (arrays.to_shards(src.mapInArrow(_count_words(shards), arrays.BLOCK_DDL), shards)
             .mapInArrow(_merge_words(folder), "shard int, path string, n long, total long").collect())
    vocab: list = [None] * shards
    sizes = [0] * shards
    for r in words:  # one row per shard
        vocab[r.shard], sizes[r.shard] = r.path, r.n
    first = [int(x) for x in np.concatenate([[0], np.cumsum(sizes)])]
    if first[-1] >= 2 ** 32 - 1:
        raise ValueError("more than 2^32 different words")
    empty = Discounts.of([0, 0, 0, 0])
    names, starts, none = arrays.Listing.write(folder, vocab), arrays.Listing.write(folder, first), arrays.Listing.empty(shards)
    model = Model(names, starts, none, none, sum(r.total for r in words), first[-1],
                  0, empty, empty, (0, 0, 0))
    if not words:
        return model

    got = staged(arrays.to_shards(src.mapInArrow(_count_pairs(model, shards), arrays.BLOCK_DDL), shards)
                 .mapInArrow(_merge_pairs(model, folder), _MERGED_DDL), "lm-pairs")
    pairs: list = [None] * shards
    types, n = 0, np.zeros(4, np.int64)
    for r in got.filter("kind = -1").select("shard", "path", "types", "n1", "n2", "n3", "n4").collect():
        pairs[r.shard] = r.path
        types += r.types
        n += [r.n1, r.n2, r.n3, r.n4]

    stats = (arrays.to_shards(got.filter("kind >= 0").select("shard", "kind", "ids", "vals"), shards)
             .mapInArrow(_merge_stats(model, folder), "shard int, path string, n array<long>").collect())
    by_word: list = [None] * shards
    m = np.zeros(5, np.int64)
    for r in stats:
        by_word[r.shard] = r.path
        m += r.n
    return Model(names, starts, arrays.Listing.write(folder, by_word), arrays.Listing.write(folder, pairs), model.n_tokens, model.n_words, types,
                 Discounts.of(list(n)), Discounts.of(list(m[:4])), (int(m[0]), int(m[1]), int(m[4])))


# --- scoring ------------------------------------------------------------------

def _gather(model: Model, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(count, total, n1, n2, n3, before) of word numbers; zeros for -1."""
    out = [np.zeros(len(ids), np.float64) for _ in range(6)]
    sid = np.clip(np.searchsorted(model.first.array(), ids, side="right") - 1, 0, len(model.vocab) - 1)
    sid[ids < 0] = -1
    for s in np.unique(sid[sid >= 0]):
        rows = np.flatnonzero(sid == s)
        at = ids[rows] - model.first[s]
        if model.words[s] is not None:
            got = arrays.shard(model.words[s])
            for o, k in zip(out[1:], _STATS):
                o[rows] = got[k][at]
        if model.vocab[s] is not None:
            counts = arrays.shard(model.vocab[s])["counts"]
            word = at < len(counts)  # the start has no count
            out[0][rows[word]] = counts[at[word]]
    return tuple(out)


def pair_counts(model: Model, keys: np.ndarray) -> np.ndarray:
    """Counts of sorted distinct pair keys."""
    out = np.zeros(len(keys), np.float64)
    sid = _pair_shard(keys, len(model.pairs))
    order = np.argsort(sid, kind="stable")
    bounds = np.searchsorted(sid[order], np.arange(len(model.pairs) + 1))
    for s in np.flatnonzero(np.diff(bounds)):
        if model.pairs[s] is None:
            continue
        rows = order[bounds[s]:bounds[s + 1]]
        got = arrays.shard(model.pairs[s])
        at = np.searchsorted(got["keys"], keys[rows])
        at = np.minimum(at, len(got["keys"]) - 1)
        c = np.where(got["keys"][at] == keys[rows], got["low"][at], 0).astype(np.float64)
        big = np.flatnonzero(c == _ESCAPE)
        c[big] = got["over"][np.searchsorted(got["over_at"], at[big])]
        out[rows] = c
    return out


def score_batch(model: Model, b: pa.RecordBatch, text: int) -> tuple:
    """(tokens, known tokens, base score, score) per text."""
    u, ids, at, n = _numbered(model, b, text)
    # index len(u): the end, len(u) + 1: the start
    ids = np.concatenate([ids, lookup_words(model, np.asarray([END])), [model.start]])
    count, total, n1, n2, n3, before = _gather(model, ids)
    count[-1] = before[-1] = 0
    ends = np.cumsum(n + 1) - 1
    prev, cur = _sequences(at, n, len(u), len(u) + 1)
    p1 = np.full(len(ids), model.rest / (model.n_words + 1))
    back = np.ones(len(ids))
    if model.pair_types:
        p1 += np.maximum(before - model.word_discounts.at(before), 0) / model.pair_types
        d = model.pair_discounts.d
        seen = total > 0
        back[seen] = (d[1] * n1[seen] + d[2] * n2[seen] + d[3] * n3[seen]) / total[seen]
    # pair counts once per distinct pair of this batch
    key = prev.astype(np.uint64) * np.uint64(len(ids)) + cur.astype(np.uint64)
    order = np.argsort(key)
    runs, length = tokens.runs(key[order])
    pv, cv = prev[order[runs]], cur[order[runs]]
    known = (ids[pv] >= 0) & (ids[cv] >= 0)
    c = np.zeros(len(pv))
    if known.any():
        full = (ids[pv[known]].astype(np.uint64) << np.uint64(32)) | ids[cv[known]].astype(np.uint64)
        by = np.argsort(full)
        found = np.empty(len(full))
        found[by] = pair_counts(model, full[by])
        c[known] = found
    p = back[pv] * p1[cv]
    seen = total[pv] > 0
    p[seen] += np.maximum(c[seen] - model.pair_discounts.at(c[seen]), 0) / total[pv[seen]]
    logp = np.empty(len(key))
    logp[order] = np.repeat(np.log10(p), length)
    base = np.log10((count + 1) / (model.n_tokens + model.n_words + 1))
    starts = ends - n

    def per_text(x):
        return np.add.reduceat(x, starts) if len(n) else np.empty(0)

    return n + 1, per_text((count[cur] > 0).astype(np.int64)), per_text(base[cur]), per_text(logp)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in arrays.slices(whole, 1):
                n, known, base, s = score_batch(model, b, 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(s)],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (add-one words),
    score (log10 probability) and perplexity per row."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    got = src.mapInArrow(_score(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return got.select("doc_id", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"),
                      "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def train_and_score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Score all rows with a model of the rows that ``learn`` selects."""
    return score(docs, train(docs.filter(learn), text_col, **options), id_col, text_col)
