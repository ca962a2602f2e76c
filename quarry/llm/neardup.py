"""Near-duplicate groups by bottom-k sketches of word shingles.

1.  Every text becomes the set of its distinct ``SHINGLE``-word shingles (64-bit
    hashes).  Texts with equal word sequences are one class, named by the
    smallest id; the rest works on one text per class.
2.  A sketch keeps the ``K`` smallest shingle hashes; sets of at most ``WHOLE``
    shingles are kept whole, so that for them every estimate is exact.
3.  Retained values are counted over all classes and ordered from rare to
    frequent.  Two sets with the overlap a link needs must share a value among
    the rarest few of each (the prefix), so only prefixes go to the inverted
    lists; what most documents share is at the end of every order.
4.  Round one compares the members of each list with one pivot, the member with
    the fewest values of its own.  Links found make groups.  Round two compares,
    in lists that still hold several groups, the members outside the list's
    largest group with the members of other groups.  Members of one group are
    never compared again, so a list of many copies costs its length, not its
    square, and no candidate is dropped.
5.  Candidates pass the union-sketch estimate (five standard deviations below
    the limit) and are then verified on whole sets.
6.  Components of the links give the groups.

Defined results: null and empty texts have an empty set and stay alone; texts
of fewer than ``SHINGLE`` words are linked with equal word sequences only; rows
that share an id are one document, linked by any of their texts; rows with a
null id stay alone; an empty table gives no rows; other columns are ignored by
``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import arrays, tokens
from .common import bounded, join_counted, staged
from .graph import components

SHINGLE = 5
K = 128            # values in a sketch
WHOLE = 256        # sets up to this size are kept whole
PART = 192         # sets above this size can meet sets that are not (3/4 of WHOLE)
# a link needs 100 |A and B| >= 75 |A or B|, that is 7 |A and B| >= 3 (|A| + |B|)
LIMIT = 0.75
NEEDED = math.floor(K * (LIMIT - 5 * math.sqrt(LIMIT * (1 - LIMIT) / K)))  # of a union sketch


def shingle_sets(texts) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(number of words, digest of the word sequence, sorted distinct shingle
    hashes) of each text of a string column."""
    h, n = tokens.word_hashes(texts)
    with np.errstate(over="ignore"):
        s = h[:max(0, len(h) - SHINGLE + 1)].copy()
        for i in range(1, SHINGLE):
            s = tokens.mix(s * np.uint64(0x9E3779B97F4A7C15)) + h[i:len(s) + i]
        s = tokens.mix(s)
    at = 0
    for words in n.tolist():
        own = h[at:at + words].tobytes()
        digest = hashlib.blake2b(own, digest_size=16).digest()
        if words >= SHINGLE:
            yield words, digest, tokens.distinct(s[at:at + words - SHINGLE + 1])
        else:  # the whole sequence as one; nothing else equals it
            yield words, digest, np.frombuffer(digest[:8], np.uint64) if words else np.empty(0, np.uint64)
        at += words


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in arrays.slices(whole, 1):
            rows = []
            for words, digest, s in shingle_sets(b.column(1)):
                kept = s if len(s) <= WHOLE else s[:K]
                k = np.frombuffer(digest, np.int64)
                rows.append((int(k[0]), int(k[1]), words, len(s),
                             kept.tobytes() if words >= SHINGLE else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))],
                                             names=["doc_id", "k1", "k2", "words", "n", "kept"])


def _values(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _value_shard(v: np.ndarray, shards: int) -> np.ndarray:
    return arrays.shard_of(tokens.mix(v), shards)  # kept values are small numbers


def _count_values(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = arrays.Tally()
        for b in batches:
            for raw in b.column(0).to_pylist():
                v = _values(raw)
                tally.parts.append((v, np.ones(len(v), np.uint32)))
                tally.held += len(v)
            if tally.full():
                keys, counts = tally.take()
                yield from arrays.blocks(keys, counts, _value_shard(keys, shards))
        keys, counts = tally.take()
        yield from arrays.blocks(keys, counts, _value_shard(keys, shards))
    return run


def _merge_values(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, keys, counts in arrays.by_shard(batches):
            shared = counts > 1
            path = arrays.write_shard(folder, {"keys": keys[shared],
                                               "counts": np.minimum(counts[shared], 2 ** 32 - 1).astype(np.uint32)})
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([path])], names=["shard", "path"])
    return run


def _frequency(paths: arrays.Listing, v: np.ndarray) -> np.ndarray:
    """Number of classes that retain each value; 1 for values of one class."""
    out = np.ones(len(v), np.int64)
    sid = _value_shard(v, len(paths))
    order = np.argsort(sid, kind="stable")
    bounds = np.searchsorted(sid[order], np.arange(len(paths) + 1))
    for s in np.flatnonzero(np.diff(bounds)):
        if paths[s] is None:
            continue
        got = arrays.shard(paths[s])
        if not len(got["keys"]):
            continue
        rows = order[bounds[s]:bounds[s + 1]]
        at = np.minimum(np.searchsorted(got["keys"], v[rows]), len(got["keys"]) - 1)
        out[rows] = np.where(got["keys"][at] == v[rows], got["counts"][at], 1)
    return out


_LISTS = "whole boolean, value long, rep long, n long, most long, pos int, own int, before array<long>"


def _list_rows(paths: arrays.Listing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                reps, ns = b.column(0).to_pylist(), b.column(1).to_pylist()
                kept = [_values(x) for x in b.column(2).to_pylist()]
                freq = _frequency(paths, np.concatenate(kept)) if kept else np.empty(0, np.int64)
                cols: list[list] = [[] for _ in range(9)]
                at = 0
                for rep, n, v in zip(reps, ns, kept):
                    f = freq[at:at + len(v)]
                    at += len(v)
                    if n <= WHOLE:
                        _prefix(cols, True, rep, n, v, f, n - -(-3 * n // 4) + 1)
                    if n > PART:
                        _prefix(cols, False, rep, n, v[:K], f[:K], K - NEEDED + 1)
                flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in cols]
                ends = np.concatenate([[0], np.cumsum(flat[7])]).astype(np.int32)
                before = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[8].astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[0].astype(bool)), *(pa.array(c.astype(np.int64)) for c in flat[1:5]),
                     *(pa.array(c.astype(np.int32)) for c in flat[5:7]), before],
                    names=["whole", "value", "rep", "n", "most", "pos", "own", "before"])
    return run


def _prefix(cols: list, whole: bool, rep: int, n: int, v: np.ndarray, f: np.ndarray, length: int) -> None:
    """The shared values among the ``length`` rarest, with their places and
    the shared values before each."""
    order = np.lexsort((v, f))[:length]
    pos = np.flatnonzero(f[order] > 1)
    if not len(pos):
        return
    private = int((f == 1).sum())
    own = private * 1000 // len(f)
    # a set that is kept whole shares with another such set no value that the
    # corpus holds once; of a sketch nothing is known about the values beyond
    most = n - private if whole else n
    shared = v[order[pos]].view(np.int64)
    count = np.arange(len(pos))
    parts = (np.full(len(pos), whole), shared, np.full(len(pos), rep), np.full(len(pos), n), np.full(len(pos), most), pos,
             np.full(len(pos), own), count, np.concatenate([shared[:i] for i in count]))
    for c, x in zip(cols, parts):
        c.append(x)


def _can_link(x: str, y: str) -> Column:
    """Whether two list entries leave room for the overlap a link needs: by
    sizes, by the values of whole sets that the corpus holds once, and by the
    places of the shared value in the two orders (if it is the first one shared,
    all before it is private)."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    p, q = F.col(f"{x}.pos"), F.col(f"{y}.pos")
    sizes = F.least(n, m) * 4 >= F.greatest(n, m) * 3
    most = F.least(f"{x}.most", f"{y}.most")
    whole = F.col(f"{x}.whole") & (F.least(n - p, m - q, most) * 7 >= (n + m) * 3)
    # values that the partner's sketch lacks, though its set may hold them
    part = ~F.col(f"{x}.whole") & (F.greatest(n, m) > WHOLE) & (F.greatest(p, q) <= K - NEEDED)
    return sizes & (whole | part)


def _ordered(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def pivot_pairs(lists: DataFrame) -> DataFrame:
    """Each list's members against its pivot."""
    pivots = lists.groupBy("whole", "value").agg(
        F.min(F.struct("own", "rep", "n", "most", "pos")).alias("p"), F.count(F.lit(1)).alias("_n")).filter("_n > 1") \
        .select("whole", "value", "p.rep", "p.n", "p.most", "p.pos")
    x, y = lists.alias("x"), pivots.alias("y")
    met = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.whole") == F.col("y.whole"))
                 & (F.col("x.rep") != F.col("y.rep")) & _can_link("x", "y"))
    return _ordered(met, "x.rep", "y.rep")


def _size_class(n: Column) -> Column:
    """Sets that can link are at most one class apart."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(4 / 3))).cast("int")


def able(mixed: DataFrame) -> DataFrame:
    """The members that a partner in their list leaves room for.

    A whole set that can share ``most`` values links with a set of m values only
    if 7 most >= 3 (n + m); the smallest m in the list, among the sizes that can
    link at all, decides.  So a family of texts just under the limit leaves its
    lists as a whole, before its members are compared."""
    sized = mixed.withColumn("_c", _size_class(F.col("n")))
    least = sized.groupBy("whole", "value", "_c").agg(F.min("n").alias("_least"))
    near = least.select("whole", "value", F.explode(F.array(*[F.col("_c") + d for d in (-1, 0, 1)])).alias("_c"), "_least") \
        .groupBy("whole", "value", "_c").agg(F.min("_least").alias("_least"))
    room = ~F.col("whole") | (F.col("most") * 7 >= (F.col("n") + F.greatest("_least", F.ceil(F.col("n") * 3 / 4))) * 3)
    return sized.join(near, ["whole", "value", "_c"]).filter(room).drop("_c", "_least")


def remaining_pairs(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """In lists of several groups: members outside the largest against members
    of other groups."""
    named = lists.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left") \
        .withColumn("group", F.coalesce("component", "rep")).drop("component")
    named = staged(named, "grouped-lists")
    sizes = named.groupBy("whole", "value", "group").agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.groupBy("whole", "value").agg(F.max_by("group", F.struct("_n", -F.col("group"))).alias("largest"),
                                                  F.count(F.lit(1)).alias("_groups")).filter("_groups > 1")
    mixed = staged(able(named.join(largest.drop("_groups"), ["whole", "value"])), "mixed-lists")
    x, y = mixed.filter(F.col("group") != F.col("largest")).alias("x"), mixed.alias("y")
    once = (F.col("y.group") == F.col("y.largest")) | (F.col("x.rep") < F.col("y.rep"))
    # a pair meets in the first list it shares: there all tests above are at
    # their widest, and it holds several groups as the pair's groups differ
    first = ~F.arrays_overlap("x.before", "y.before")
    met = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.whole") == F.col("y.whole"))
                 & (F.col("x.group") != F.col("y.group")) & once & _can_link("x", "y") & first)
    return _ordered(met, "x.rep", "y.rep")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    z = np.sort(np.concatenate([x, y]))
    return int((z[1:] == z[:-1]).sum())


def _union_sketch(x: np.ndarray, y: np.ndarray) -> int:
    """Common values among the K smallest of the union of two sketches."""
    z = np.sort(np.concatenate([x[:K], y[:K]]))
    same = z[1:] == z[:-1]
    distinct = np.cumsum(np.concatenate(([True], ~same)))
    return int((same & (distinct[1:] <= K)).sum())


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c, na, nb = (b.column(i).to_pylist() for i in range(4))
        state = []
        for n, m, x, y in zip(na, nb, b.column(4), b.column(5)):
            x, y = _values(x.as_buffer()), _values(y.as_buffer())
            if max(n, m) <= WHOLE:
                state.append(2 if 7 * _common(x, y) >= 3 * (n + m) else 0)
            else:
                state.append(1 if _union_sketch(x, y) >= NEEDED else 0)
        out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(state, pa.int32())],
                                         names=["a", "b", "state"])
        yield out.filter(pa.array([s > 0 for s in state], pa.bool_()))


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in arrays.slices(whole, 1):
            sets = [s.tobytes() for _, _, s in shingle_sets(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["rep", "s"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = _values(x.as_buffer()), _values(y.as_buffer())
            ok.append(7 * _common(x, y) >= 3 * (len(x) + len(y)))
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links: by the union sketch, then on whole sets."""
    side = reps.select("rep", "n", "kept")
    both = (pairs.join(side.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("kept").alias("ka")), "a")
            .join(side.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("kept").alias("kb")), "b")
            .select("a", "b", "na", "nb", "ka", "kb"))
    judged = staged(both.mapInArrow(arrays.lean(_estimate), "a long, b long, state int"), "estimated")
    sure = judged.filter("state = 2").select("a", "b")
    open_ = judged.filter("state = 1").select("a", "b")
    ids = staged(open_.select(F.col("a").alias("rep")).unionByName(open_.select(F.col("b").alias("rep"))).distinct(), "open-ids")
    sets = staged(docs.join(bounded(ids), docs["doc_id"] == ids["rep"], "left_semi")
                  .mapInArrow(arrays.lean(_whole_sets), "rep long, s binary"), "whole-sets")
    full = (open_.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb"))
    return staged(full.mapInArrow(arrays.lean(_verify), "a long, b long").unionByName(sure).distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                    shard_values: int = 2_000_000) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest
    id of the group), kept (whether the row has that id).  ``shard_values``:
    values per shard of the frequency table, whatever the size of the corpus."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = staged(src.mapInArrow(arrays.lean(_sketch), "doc_id long, k1 long, k2 long, words long, n long, kept binary"), "sketches")
    named = rows.filter("doc_id is not null and words > 0")
    classes = staged(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_rows")), "equal-texts")
    # one sketch per class of equal texts, combined before the shuffle
    reps = staged(named.filter("kept is not null").groupBy("k1", "k2")
                  .agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "n", "kept")).alias("s"))
                  .select("rep", "s.n", "s.kept"), "classes")
    total = reps.agg(F.coalesce(F.sum(F.octet_length("kept").cast("long")), F.lit(0))).first()[0] // 8
    shards = max(1, -(-total // shard_values))
    folder = scratch_path(spark, "llm-frequency")
    paths: list = [None] * shards
    for r in (arrays.to_shards(reps.select("kept").mapInArrow(arrays.lean(_count_values(shards)), arrays.BLOCK_DDL), shards)
              .mapInArrow(arrays.lean(_merge_values(folder)), "shard int, path string").collect()):  # one row per shard
        paths[r.shard] = r.path
    lists = staged(reps.select("rep", "n", "kept").mapInArrow(arrays.lean(_list_rows(arrays.Listing.write(folder, paths))), _LISTS), "lists")

    first = pivot_pairs(lists)
    links = verified(first, reps, src)
    groups = staged(components(links), "groups")
    more = remaining_pairs(lists, groups)
    more = verified(more, reps, src)
    # groups stand for the links found so far
    edges = groups.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more)
    # rows that share an id are one document: an id with several texts links
    # each of their classes with the first
    several = named.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi")) \
        .filter("lo <> hi").select("doc_id")
    texts = named.join(bounded(staged(several, "several-texts")), "doc_id", "left_semi").select("doc_id", "k1", "k2").distinct()
    texts = staged(texts.join(classes, ["k1", "k2"]).select("doc_id", "rep"), "texts-of-an-id")
    first_of = texts.groupBy("doc_id").agg(F.min("rep").alias("a"))
    edges = edges.unionByName(texts.join(first_of, "doc_id").filter("a <> rep").select("a", F.col("rep").alias("b")))
    final = staged(components(edges), "components")
    of_class = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("k1", "k2", "n_rows", F.coalesce("component", "rep").alias("component"))
    thin = rows.select("doc_id", "k1", "k2", "words", F.col("n").alias("n_shingles"))
    inside = join_counted(thin.filter("doc_id is not null and words > 0"), staged(of_class, "classes-components"),
                          ["k1", "k2"], "n_rows")
    # texts without words, and rows without an id, are in no class
    outside = thin.filter("doc_id is null or words <= 0").withColumn("component", F.lit(None).cast("long"))
    out = inside.unionByName(outside)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of every group, that of the smallest id."""
    found = near_duplicates(docs, id_col, text_col)
    drop = bounded(staged(found.filter("not kept").select(F.col("doc_id").alias("dropped")).distinct(), "near-copies"))
    return docs.join(drop, docs[id_col].cast("long") == drop["dropped"], "left_anti")
