"""Dense vectors: cosine, normalisation, document vectors and exact k-NN.

Rows: V1, V2, J7, A9, J9, J11, J12 (and the dense half of V10/V13).

Exact all-pairs scoring (J9/J11) is a *block join*: each side is cut into
hash blocks of a bounded number of rows (block count from a row count, never a
constant); every (query block, item block) pair meets in one cogroup, where
numpy multiplies the two blocks and keeps the local top-k (or the pairs over
a threshold).  A final per-query window keeps the global top-k.  Groups are
bounded by the block size whatever the key distribution, so no hot key can
land in one task, and no row-level cartesian product is ever planned.

Multi-field scoring uses the identity  sum_f cos(q_f, d_f) = <q', d'>  where
x' is the concatenation of the unit-normalised field vectors of x.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.strategy import block_count, lookup, materialize
from .buckets import Buckets, scored_candidates
from .sparse import rank_results


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """V1: dot / (|a| |b|), 0 when a norm is 0."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def unit_normalize(a) -> Column:
    """V2: a / |a| (a zero vector stays zero), as array<double>.

    The norm is evaluated once per row (outside the element lambda) and paired
    with every element, so the cost is O(d), not O(d^2)."""
    n = norm(a)
    safe = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.zip_with(_c(a), F.array_repeat(safe, F.size(_c(a))),
                      lambda x, m: x.cast("double") / m)


def lookup_vectors(tokens: DataFrame, vectors: DataFrame, oov: str = "unk",
                   unk_token: str = "<unk>", subwords: DataFrame | None = None) -> DataFrame:
    """(…, token) -> (…, token, vector); oov='unk' maps misses to the
    unk vector, oov='skip' drops them.  With ``subwords`` (a
    ``models.subword_table``) misses are looked up by their character n-grams
    first (Q17).  The vocabulary is broadcast only within a byte budget; beyond
    it its most frequent tokens are."""
    if subwords is not None:
        from .models import unseen_word_vectors
        missing = tokens.select("token").distinct().join(vectors.select("token"), "token", "left_anti")
        known = vectors.select("token", F.col("vector").cast("array<double>").alias("vector"))
        vectors = known.unionByName(unseen_word_vectors(missing, subwords))
    j = lookup(tokens, vectors.select("token", "vector"), "token").select(*tokens.columns, "vector")
    if oov == "skip":
        return j.filter(F.col("vector").isNotNull())
    return j.select(*[c for c in j.columns if c != "vector"],
                    F.coalesce("vector", unk_literal(vectors, unk_token)).alias("vector"))


def unk_literal(vectors: DataFrame, unk_token: str = "<unk>", normalize: bool = False) -> Column:
    """The unk vector as a literal array column: one model parameter of d
    numbers read once (no join; null when the model has no unk entry)."""
    row = vectors.filter(F.col("token") == unk_token).select("vector").first()
    if row is None or row[0] is None:
        return F.lit(None).cast("array<double>")
    v = [float(x) for x in row[0]]
    if normalize:
        n = sum(x * x for x in v) ** 0.5
        v = [x / n for x in v] if n else v
    return F.array(*[F.lit(x) for x in v])


def mean_unit_vector(token_vectors: DataFrame, keys: list[str],
                     vector_col: str = "vector", weight_col: str | None = None) -> DataFrame:
    """Mean of the unit-normalised token vectors per key (optionally
    weighted by a token count column).

    Uses the JVM ``Summarizer.mean`` aggregate (partial aggregation, no
    per-dimension explode)."""
    cols = [*keys, array_to_vector(unit_normalize(vector_col)).alias("_v")]
    if weight_col:
        cols.append(F.col(weight_col).cast("double").alias("_w"))
    v = token_vectors.select(*cols)
    agg = Summarizer.mean(F.col("_v"), F.col("_w")) if weight_col else Summarizer.mean(F.col("_v"))
    m = v.groupBy(*keys).agg(agg.alias("_m"))
    return m.select(*keys, vector_to_array("_m").alias("vector"))


# White space of a text that is split into vector tokens: every Unicode space.
SPACE_PATTERN = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+"


def space_tokens(text) -> Column:
    """The white-space separated tokens of a text; a null or blank text has none."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), SPACE_PATTERN), lambda t: t != "")


def unit_vocabulary(word_vectors: DataFrame) -> DataFrame:
    """(token, vector) with every vector of unit length."""
    return word_vectors.select("token", unit_normalize("vector").alias("vector"))


def doc_vectors(docs: DataFrame, word_vectors: DataFrame, id_col: str, text_col: str = "text",
                field_col: str | None = "field", oov: str = "unk",
                unk_token: str = "<unk>") -> DataFrame:
    """A9/V8/V13 (dense): (id, [field,] vector) = mean of the unit vectors of
    all white-space tokens of the text; a token without a vector counts as the
    unk vector, and a text without tokens is the unk vector.  oov='skip' leaves
    missing tokens, and texts without a known token, out.

    Tokens of a text stay in their task up to the partial mean: the vocabulary
    is broadcast, or its most frequent tokens are if it is too large; then only
    the occurrences of the other tokens are shuffled."""
    keys = [id_col] + ([field_col] if field_col else [])
    tokens = docs.select(*keys, F.explode_outer(space_tokens(text_col)).alias("token"))
    if oov == "skip":
        tokens = tokens.filter(F.col("token").isNotNull())
    word_vectors = materialize(word_vectors)
    dims = word_vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    found = lookup(tokens, unit_vocabulary(word_vectors), "token").select(*keys, "vector")
    if oov == "skip":
        found = found.filter(F.col("vector").isNotNull())
    else:
        found = found.select(*keys, F.coalesce("vector", unk_literal(word_vectors, unk_token, True)).alias("vector"))
    return vector_means(found, keys, dims)


def vector_means(rows: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """(keys, vector): the mean of the vectors of ``dims`` numbers per key, by
    sums of plain columns, which a hash aggregate adds up in place."""
    sums = [F.sum(F.get("vector", F.lit(i))).alias(f"_s{i}") for i in range(dims)]
    s = rows.groupBy(*keys).agg(F.count("vector").alias("_n"), *sums)
    mean = F.array(*[F.try_divide(f"_s{i}", "_n") for i in range(dims)]).cast("array<double>")
    return s.select(*keys, F.when(F.col("_n") > 0, mean).alias("vector"))


def field_concat(index: DataFrame, id_col: str, fields: list[str],
                 weights: dict | None = None) -> DataFrame:
    """Long (id, field, vector) -> (id, vec) with the unit field vectors
    concatenated in ``fields`` order (missing field -> zeros)."""
    u = index.select(id_col, "field", unit_normalize("vector").alias("u"))
    if weights:
        wmap = F.create_map(*[x for kv in weights.items() for x in (F.lit(kv[0]), F.lit(float(kv[1])))])
        u = u.withColumn("u", F.transform("u", lambda x: x * wmap[F.col("field")]))
    g = u.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("field", "u"))).alias("m"))
    dims = F.size(F.map_values("m")[0])
    parts = [F.coalesce(F.col("m")[f], F.array_repeat(F.lit(0.0), dims)) for f in fields]
    return g.select(id_col, F.concat(*parts).alias("vec"))


# Bytes of the score matrix that a task holds at a time.
SCORE_BYTES = 32 << 20


def score_slices(n_queries: int, n_items: int, budget_bytes: int = SCORE_BYTES) -> list[slice]:
    """Slices of the query rows so that scores against ``n_items`` items fit
    the budget (one row at least)."""
    step = max(1, budget_bytes // (8 * max(1, n_items)))
    return [slice(a, min(a + step, n_queries)) for a in range(0, n_queries, step)]


def _tag_mask(qtags, itags) -> np.ndarray | None:
    """Allowed (query, item) pairs: the item's tags overlap the query's tags;
    a query without tags allows every item.  None when nothing is filtered."""
    if qtags is None or all(t is None or len(t) == 0 for t in qtags):
        return None
    vocab = {t: i for i, t in enumerate({t for ts in qtags if ts is not None for t in ts})}
    Qt = np.zeros((len(qtags), len(vocab)), dtype=np.float32)
    for r, ts in enumerate(qtags):
        for t in (ts if ts is not None else ()):
            Qt[r, vocab[t]] = 1.0
    It = np.zeros((len(itags), len(vocab)), dtype=np.float32)
    for r, ts in enumerate(itags):
        for t in (ts if ts is not None else ()):
            j = vocab.get(t)
            if j is not None:
                It[r, j] = 1.0
    allowed = (Qt @ It.T) > 0
    unfiltered = np.array([ts is None or len(ts) == 0 for ts in qtags])
    allowed[unfiltered, :] = True
    return allowed


def _best(scores: np.ndarray, pids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best finite scores of a row, by (score desc, id asc):
    a partial selection finds the k-th score, and only columns at or above it
    are sorted."""
    if len(scores) > k:
        kth = scores[np.argpartition(-scores, k - 1)[k - 1]]
        cand = np.flatnonzero(scores >= kth)
    else:
        cand = np.arange(len(scores))
    cand = cand[np.isfinite(scores[cand])]
    return cand[np.lexsort((pids[cand], -scores[cand]))[:k]]


class BestScores:
    """The k best scores per query over slices of scores, by (score desc, id
    asc); scores of -inf are none."""

    def __init__(self, qids, k, round_to):
        self.qids, self.k, self.round_to = qids, k, round_to
        self.best: list = [(np.empty(0), np.empty(0, np.int64))] * len(qids)
        # the k-th score of every query so far; what rounding may add to a score
        self.kth = np.full(len(qids), -np.inf)
        self.slack = 2.0 * 10.0 ** -round_to

    def keep(self, start: int, S: np.ndarray, pids: np.ndarray) -> None:
        """Merges a slice of scores into the k best so far, by (score desc, id
        asc).  Only scores that reach a row's k-th one are rounded and sorted."""
        n, m = S.shape
        low = self.kth[start:start + n]
        fresh = np.flatnonzero(np.isneginf(low))
        if len(fresh) and m > self.k:
            low = low.copy()
            low[fresh] = np.partition(S[fresh], m - self.k, axis=1)[:, m - self.k]
        r, c = np.nonzero((S >= (low - self.slack)[:, None]) & (S > -np.inf))
        if not len(r):
            return
        s, p = np.round(S[r, c], self.round_to), pids[c]
        order = np.lexsort((p, -s, r))
        r, s, p = r[order], s[order], p[order]
        first = np.searchsorted(r, np.arange(n + 1))
        for i in np.unique(r):
            a, b = first[i], min(first[i + 1], first[i] + self.k)
            s0, p0 = self.best[start + i]
            s1, p1 = np.concatenate([s0, s[a:b]]), np.concatenate([p0, p[a:b]])
            keep = _best(s1, p1, self.k)
            self.best[start + i] = (s1[keep], p1[keep])
            if len(keep) == self.k:
                self.kth[start + i] = s1[keep[-1]]

    def result(self) -> pd.DataFrame:
        if not len(self.qids):
            return pd.DataFrame({"qid": np.empty(0, np.int64), "pid": np.empty(0, np.int64), "sim": np.empty(0)})
        return pd.DataFrame({"qid": np.repeat(self.qids, [len(s) for s, _ in self.best]),
                             "pid": np.concatenate([p for _, p in self.best]),
                             "sim": np.concatenate([s for s, _ in self.best])})


class _Scorer(BestScores):
    """Scores query rows against item batches in bounded slices, and keeps the
    k best per query or yields the pairs over a threshold."""

    def __init__(self, qids, Q, qtags, k, threshold, exclude_self, round_to):
        super().__init__(qids, k, round_to)
        self.Q, self.qtags = Q, qtags
        self.threshold, self.exclude_self = threshold, exclude_self
        self.finite = bool(np.isfinite(Q).all())

    def add(self, pids, D, itags):
        """Yields frames of pairs over the threshold; top-k rows are kept."""
        for rows in score_slices(len(self.qids), len(pids)):
            S = self.Q[rows] @ D.T
            if not (self.finite and np.isfinite(D).all()):
                S[~np.isfinite(S)] = -np.inf
            if self.exclude_self:
                S[self.qids[rows, None] == pids[None, :]] = -np.inf
            if self.qtags is not None:
                mask = _tag_mask(self.qtags[rows], itags)
                if mask is not None:
                    S[~mask] = -np.inf
            if self.threshold is not None:
                r, c = np.nonzero(S > self.threshold - self.slack)
                s = np.round(S[r, c], self.round_to)
                r, c, s = (x[s > self.threshold] for x in (r, c, s))
                yield pd.DataFrame({"qid": self.qids[rows][r], "pid": pids[c], "sim": s})
                continue
            self.keep(rows.start, S, pids)


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["vec"].to_numpy()).astype(np.float64)


def _tags_of(frame: pd.DataFrame) -> list | None:
    return [list(t) if t is not None else None for t in frame["tags"]] if "tags" in frame.columns else None


def _knn_blocks(q: pd.DataFrame, it: pd.DataFrame, k: int | None, threshold: float | None,
                exclude_self: bool, round_to: int) -> pd.DataFrame:
    empty = pd.DataFrame({"qid": pd.Series([], dtype="int64"), "pid": pd.Series([], dtype="int64"),
                          "sim": pd.Series([], dtype="float64")})
    if len(q) == 0 or len(it) == 0:
        return empty
    qtags = _tags_of(q) if "tags" in it.columns else None
    sc = _Scorer(q["qid"].to_numpy(np.int64), _matrix(q), qtags, k, threshold, exclude_self, round_to)
    found = list(sc.add(it["pid"].to_numpy(np.int64), _matrix(it), _tags_of(it)))
    return pd.concat([empty, *found]) if threshold is not None else sc.result()


def broadcast_knn(queries: DataFrame, items: DataFrame, k: int | None = None,
                  threshold: float | None = None, exclude_self: bool = False,
                  round_to: int = 6) -> DataFrame:
    """Small query side: its matrix is broadcast (the caller checked its
    size), the items are streamed partition by partition with no shuffle;
    each partition keeps a running top-k per query (or yields the pairs over
    the threshold), so it emits at most |queries| x k rows.  Scores exist in
    slices of ``SCORE_BYTES`` only."""
    spark = queries.sparkSession
    tagged = "tags" in queries.columns and "tags" in items.columns
    qp = queries.select("qid", "vec", *(["tags"] if tagged else [])).toPandas()
    qids = qp["qid"].to_numpy(np.int64)
    Q = _matrix(qp) if len(qp) else np.zeros((0, 0))
    bq = spark.sparkContext.broadcast((qids, Q, _tags_of(qp) if tagged else None))

    def fn(batches):
        qids_, Q_, qtags_ = bq.value
        sc = _Scorer(qids_, Q_, qtags_, k, threshold, exclude_self, round_to)
        for pdf in batches:
            if len(pdf) and len(qids_):
                yield from sc.add(pdf["pid"].to_numpy(np.int64), _matrix(pdf), _tags_of(pdf))
        if threshold is None:
            yield sc.result()

    cols = [F.col("pid").cast("long"), "vec"] + (["tags"] if tagged else [])
    return items.select(*cols).mapInPandas(fn, "qid long, pid long, sim double")


BLOCK_BYTES = 64 << 20
# Bytes of the vectors of a block from which only the k best scores are kept.
TOP_BLOCK_BYTES = 16 << 20


def derived_block_rows(dim: int, budget_bytes: int = BLOCK_BYTES) -> int:
    """Rows per block so that one block of vectors (rows x dim x 8 bytes) and
    the block-pair score matrix (rows^2 x 8 bytes) each fit ``budget_bytes``."""
    by_vectors = budget_bytes // (8 * max(1, dim))
    by_scores = int((budget_bytes / 8) ** 0.5)
    return int(max(64, min(by_vectors, by_scores)))


def shuffled_block_rows(dim: int, k: int | None, least: int | None = None) -> int:
    """Rows per block of a join whose blocks are shuffled.  A block travels once
    per block of the other side, so blocks are as large as memory allows; the
    pairs over a threshold (``k`` None) may be all pairs of two blocks."""
    return max(least or 1, derived_block_rows(dim) if k is None else TOP_BLOCK_BYTES // (8 * dim))


def block_pairs_join(queries: DataFrame, items: DataFrame, k: int | None = None,
                     threshold: float | None = None, exclude_self: bool = False,
                     block_rows: int | None = None, round_to: int = 6,
                     n_queries: int | None = None, n_items: int | None = None,
                     broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Core of J9/J11.  queries (qid, vec), items (pid, vec) -> (qid, pid, sim)
    with the local top-k per (query, item partition or block), or all pairs
    over the threshold.

    A query side whose matrix fits ``broadcast_bytes`` (checked from its row
    count and width) takes the broadcast path; otherwise both sides are cut
    into hash blocks and every (query block, item block) pair meets in one
    cogroup."""
    # both sides are reused (count, then the join): materialise once
    same = items is queries
    queries = materialize(queries)
    items = queries if same else materialize(items)
    sizes = [F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")]
    if "tags" in queries.columns:
        sizes.append(F.sum(F.octet_length(F.array_join("tags", "")) + 64 * F.size("tags")).alias("t"))
    st = queries.agg(*sizes).first().asDict()
    nq = n_queries if n_queries is not None else st["n"]
    if nq * 8 * (st["d"] or 0) + (st.get("t") or 0) <= broadcast_bytes:
        return broadcast_knn(queries, items, k, threshold, exclude_self, round_to)
    block_rows = shuffled_block_rows(st["d"] or 1, k, block_rows)
    ni = n_items if n_items is not None else items.count()
    QB, IB = block_count(nq, block_rows), block_count(ni, block_rows)
    tagged = "tags" in queries.columns and "tags" in items.columns
    extra = ["tags"] if tagged else []
    q = (queries.select(F.col("qid").cast("long"), "vec", *extra,
                        F.pmod(F.xxhash64("qid"), F.lit(QB)).alias("qb"))
         .withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(IB - 1)).cast("array<long>"))))
    i = (items.select(F.col("pid").cast("long"), "vec", *extra,
                      F.pmod(F.xxhash64("pid"), F.lit(IB)).alias("ib"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(QB - 1)).cast("array<long>"))))

    def fn(qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
        return _knn_blocks(qpdf, ipdf, k, threshold, exclude_self, round_to)

    return (q.groupBy("qb", "ib").cogroup(i.groupBy("qb", "ib"))
            .applyInPandas(fn, "qid long, pid long, sim double"))


def knn_join_vectors(qv: DataFrame, iv: DataFrame, k: int, exclude_self: bool = False,
                     block_rows: int | None = None, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Exact top-k over already concatenated unit vectors:
    qv (qid, vec), iv (pid, vec) -> (qid, pid, sim, rank)."""
    local = block_pairs_join(qv, iv, k=k, exclude_self=exclude_self, block_rows=block_rows,
                             broadcast_bytes=broadcast_bytes)
    return rank_results(local, k, "qid", "pid")


def knn_join_dense(queries: DataFrame, index: DataFrame, k: int, fields: list[str],
                   qid: str = "query_id", pid: str = "post_id", exclude_self: bool = False,
                   weights: dict | None = None, block_rows: int | None = None,
                   broadcast_bytes: int = 64 << 20, approximate: Buckets | None = None) -> DataFrame:
    """J9 (+V10 dense): exact top-k of summed per-field cosine.

    queries: (qid, field, vector); index: (pid, field, vector) long form.
    Returns (qid, pid, sim, rank).  ``approximate`` (opt-in): only posts that
    share a random-projection bucket with the query are scored."""
    qv = field_concat(queries.withColumnRenamed(qid, "qid"), "qid", fields, weights)
    iv = field_concat(index.withColumnRenamed(pid, "pid"), "pid", fields)
    if approximate:
        ranked = rank_results(scored_candidates(qv, iv, approximate, exclude_self, k=k), k, "qid", "pid")
    else:
        ranked = knn_join_vectors(qv, iv, k, exclude_self, block_rows, broadcast_bytes)
    return ranked.select(F.col("qid").alias(qid), F.col("pid").alias(pid), "sim", "rank")


def threshold_join(queries: DataFrame, index: DataFrame, t: float, fields: list[str],
                   qid: str = "query_id", pid: str = "post_id", exclude_self: bool = True,
                   mean: bool = True, block_rows: int | None = None,
                   broadcast_bytes: int = 64 << 20, approximate: Buckets | None = None) -> DataFrame:
    """All pairs whose (mean over fields, or summed) cosine exceeds t.
    ``approximate`` (opt-in): of these, the pairs that share a random-projection
    bucket; ``Buckets.expected_recall`` says how many that are."""
    w = {f: (1.0 / len(fields) if mean else 1.0) for f in fields}
    qv = field_concat(queries.withColumnRenamed(qid, "qid"), "qid", fields, w)
    iv = field_concat(index.withColumnRenamed(pid, "pid"), "pid", fields)
    if approximate:
        near = scored_candidates(qv, iv, approximate, exclude_self, threshold=t)
        return near.select(F.col("qid").alias(qid), F.col("pid").alias(pid), "sim")
    pairs = block_pairs_join(qv, iv, threshold=t, exclude_self=exclude_self, block_rows=block_rows,
                             broadcast_bytes=broadcast_bytes)
    return pairs.select(F.col("qid").alias(qid), F.col("pid").alias(pid), "sim")


def pair_similarity(pairs: DataFrame, index: DataFrame, fields: list[str],
                    src: str = "src_id", dst: str = "dst_id") -> DataFrame:
    """Per-field cosine and their mean for given id pairs only
    (two equi-joins on the wide field table; no all-pairs work)."""
    wide = index.groupBy("post_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "vector"))).alias("m"))
    a = wide.select(F.col("post_id").alias(src), F.col("m").alias("ma"))
    b = wide.select(F.col("post_id").alias(dst), F.col("m").alias("mb"))
    j = pairs.select(src, dst).join(a, src).join(b, dst)
    raw = [cosine(F.col("ma")[f], F.col("mb")[f]).alias(f"sim_{f}") for f in fields]
    out = j.select(src, dst, *raw)
    mean = sum(F.col(f"sim_{f}") for f in fields) / len(fields)
    return out.select(src, dst, *[F.round(f"sim_{f}", 6).alias(f"sim_{f}") for f in fields],
                      F.round(mean, 6).alias("sim_mean"))
