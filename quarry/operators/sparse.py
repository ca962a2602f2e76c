"""Sparse (TF-IDF) model, postings and sparse top-k search.

Rows: A8 document_frequencies/idf, V3 tfidf_fit, V4 tfidf_transform,
V13 (sparse query vectors), J10 knn_join_sparse, J11 threshold_join_sparse.

Tables are long postings ``(id, field, term, weight)``; a query meets only the
documents that share a term with it (term equi-join), so zero-overlap pairs
never materialise.  Per-document work (term counts, L2 norm) runs after one
hash partitioning on the document id; the idf table and the query side are
broadcast only behind a row-count check.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.strategy import FREQUENT_ROWS, block_count, checked_broadcast, frequent_first, lookup, materialize
from ..resources import stop_words

# Token rule: runs of two or more characters that are not white space (the
# Unicode white space, spelt out so that engines read it identically); "c++",
# "c#", ".net" and "java.util.Map" are tokens.
TOKEN_PATTERN = r"[^\x09-\x0D\x1C-\x20\x{85}\p{Z}]{2,}"

# ``stop``: True for the English list of ``resources``, False for none, or a
# collection of words.
Stop = bool | tuple[str, ...] | list[str] | frozenset[str]


def _stop_list(stop: Stop) -> tuple[str, ...]:
    return (stop_words() if stop else ()) if isinstance(stop, bool) else tuple(sorted(stop))


def analyzer(text: Column, stop: Stop = True) -> Column:
    """lowercase -> tokens of two or more non-space characters -> minus stop words."""
    toks = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)
    words = _stop_list(stop)
    # a literal IN-list this long is planned as a hash set (InSet)
    return F.filter(toks, lambda t: ~t.isin(*words)) if words else toks


# Text that one task splits into terms and counts.
TASK_TEXT_BYTES = 4 << 20


def text_tasks(docs: DataFrame, text_col: str) -> int:
    """Tasks that the texts are dealt to, ``TASK_TEXT_BYTES`` each.  The count is
    taken from the texts, as their terms are many times larger than the shuffled
    bytes by which Spark would merge its partitions."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return block_count(total, TASK_TEXT_BYTES)


def term_counts(docs: DataFrame, id_col: str, text_col: str, field_col: str | None = None,
                stop: Stop = True, prepartitioned: bool = False, tasks: int | None = None) -> DataFrame:
    """(id, [field,] term, tf) — raw term counts per document (and field).

    The input is hash-partitioned by the document id once, into ``tasks``
    partitions (``text_tasks`` when not given), so the count, the norm window and
    a later per-document aggregation reuse that partitioning.
    """
    keys = [id_col] + ([field_col] if field_col else [])
    d = docs if prepartitioned else docs.repartition(tasks or text_tasks(docs, text_col), id_col)
    # stop words are removed as rows after the explode (a code-generated
    # filter on a hashed IN set), not inside an interpreted array lambda
    ex = d.select(*keys, F.explode(analyzer(F.col(text_col), stop=False)).alias("term"))
    if words := _stop_list(stop):
        ex = ex.filter(~F.col("term").isin(*words))
    return ex.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def idf_table(tf: DataFrame, id_col: str, n_docs: int | None = None) -> DataFrame:
    """Smooth idf = ln((1 + N) / (1 + df)) + 1 over one field's counts.

    ``tf`` holds one row per (document, term); df is therefore a plain count.
    """
    if n_docs is None:
        n_docs = tf.select(id_col).distinct().count()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", "df",
                     (F.log((F.lit(1.0) + n_docs) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def tfidf_fit(docs: DataFrame, id_col: str, text_col: str, stop: Stop = True) -> DataFrame:
    """V3: fit the vocabulary + idf on a document table -> (term, df, idf)."""
    tf = term_counts(docs, id_col, text_col, stop=stop)
    n = docs.count()  # documents are unique by id (model contract); empty ones count too
    return idf_table(tf, id_col, n)


def tfidf_transform(idf: DataFrame, docs: DataFrame, id_col: str, text_col: str,
                    field_col: str | None = None, stop: Stop = True,
                    max_broadcast_terms: int = FREQUENT_ROWS) -> DataFrame:
    """V4: postings (id, [field,] term, weight) — tf*idf, L2-normalised per
    document (and field); terms unseen at fit time are dropped."""
    keys = [id_col] + ([field_col] if field_col else [])
    tasks = text_tasks(docs, text_col)
    tf = term_counts(docs, id_col, text_col, field_col, stop, tasks=tasks)
    return postings_from_counts(tf, idf, keys, max_broadcast_terms, tasks)


def postings_from_counts(tf: DataFrame, idf: DataFrame, keys: list[str],
                         max_broadcast_terms: int = FREQUENT_ROWS, tasks: int | None = None) -> DataFrame:
    """V4 second half: (keys, term, tf) x idf -> unit-length postings.  The
    norm window is partitioned by the document keys, which the term counts
    are already hash-partitioned by (no further exchange).

    Of a vocabulary too large to broadcast, the frequent terms (of small idf)
    are: ``tf`` stays where it is, and only its rows of rare terms go to their
    idf and back, to the ``tasks`` partitions of the first of ``keys``.  Without
    ``tasks`` all of ``tf`` is shuffled by term instead."""
    vocab = materialize(idf.select("term", "idf"))
    often, rare = frequent_first(vocab, -F.col("idf"), max_broadcast_terms)
    if rare is None:
        met = tf.join(often, "term")
    elif tasks is None:
        met = tf.join(vocab, "term")
    else:
        far = tf.join(often, "term", "left_anti").join(rare, "term").repartition(tasks, keys[0])
        met = tf.join(often, "term").unionByName(far)
    w = met.select(*keys, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return w.select(*keys, "term", (F.col("w") / norm).alias("weight"))


def knn_join_sparse(queries: DataFrame, postings: DataFrame, k: int | None,
                    qid: str = "query_id", pid: str = "post_id", field_col: str | None = "field",
                    weights: dict | None = None, round_to: int = 6,
                    max_broadcast_rows: int = 2_000_000, term_buckets: int | None = None) -> DataFrame:
    """J10 + V10 + W1: score = sum over fields (optionally weighted) of the
    dot product of unit query and document postings; exact top-k per query.

    queries: (qid, term, weight); postings: (pid, [field,] term, weight).
    Returns (qid, pid, sim, rank), or the unranked (qid, pid, sim) when k is
    None (no window over all pairs of a query).  Similarities are rounded
    before ranking and ties break on pid, so the order is total.

    ``term_buckets``: the postings are a stored index partitioned by
    ``_bucket = pmod(xxhash64(term), term_buckets)``; the distinct buckets of
    the query terms (at most ``term_buckets`` small integers) become a
    partition filter, so only those index partitions are read, and the join
    also matches the bucket.
    """
    qsel = [qid, "term", F.col("weight").alias("qw")]
    keys = ["term"]
    if term_buckets:
        qsel.append(F.pmod(F.xxhash64("term"), F.lit(term_buckets)).cast("int").alias("_bucket"))
        keys = ["_bucket", "term"]
    q = checked_broadcast(queries.select(*qsel), max_broadcast_rows)
    d = postings.withColumnRenamed("weight", "dw")
    if term_buckets:
        wanted = [r[0] for r in q.select("_bucket").distinct().collect()]
        d = d.filter(F.col("_bucket").isin(wanted))
    prod = F.col("qw") * F.col("dw")
    if weights and field_col:
        wmap = F.create_map(*[x for kv in weights.items() for x in (F.lit(kv[0]), F.lit(float(kv[1])))])
        prod = prod * wmap[F.col(field_col)]
    j = d.join(q, keys).select(qid, pid, prod.alias("p"))
    scores = j.groupBy(qid, pid).agg(F.round(F.sum("p"), round_to).alias("sim"))
    return rank_results(scores, k, qid, pid) if k else scores


def rank_results(scores: DataFrame, k: int | None, qid: str = "query_id",
                 pid: str = "post_id", sim: str = "sim") -> DataFrame:
    """rank = row_number over (qid order by sim desc, pid); keep rank <= k.

    The filter on row_number lets Catalyst plan a per-group limit
    (WindowGroupLimit) ahead of the window exchange.
    """
    w = Window.partitionBy(qid).orderBy(F.col(sim).desc(), F.col(pid))
    r = scores.withColumn("rank", F.row_number().over(w))
    return r.filter(F.col("rank") <= k) if k else r


def fill_to_k(ranked: DataFrame, queries: DataFrame, posts: DataFrame, k: int, qid: str = "query_id",
              pid: str = "post_id", tags_col: str | None = None, post_tags: str = "etags") -> DataFrame:
    """Ranked rows (qid, pid, sim, rank) completed to min(k, posts) per query
    with posts of score 0, in the order of their ids.

    A query with fewer than k rows has all its scored posts among them, so the
    first k posts by id hold enough others; no table of all pairs is built.
    With ``tags_col`` (an array of the queries) a query that names tags is
    completed from the posts that carry one of them: the first k posts of every
    tag hold enough."""
    ranked = materialize(ranked.select(qid, pid, "sim", "rank"))
    have = ranked.groupBy(qid).agg(F.count(F.lit(1)).alias("_n"))
    names = [F.col(tags_col).alias("_tags")] if tags_col else []
    short = queries.select(qid, *names).join(have, qid, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    short = materialize(short.filter(F.col("_n") < k))
    if short.isEmpty():
        return ranked
    firsts = [r[0] for r in posts.select(pid).distinct().orderBy(pid).limit(k).collect()]
    any_post = F.array(*[F.lit(i) for i in firsts]) if firsts else F.array().cast("array<long>")
    free = F.size("_tags") <= 0 if tags_col else F.lit(True)
    if tags_col:
        free = F.col("_tags").isNull() | free
    offered = short.filter(free).select(qid, "_n", F.explode(any_post).alias(pid))
    if tags_col:
        w = Window.partitionBy("_tag").orderBy(pid)
        per_tag = posts.select(pid, F.explode(F.array_distinct(post_tags)).alias("_tag")) \
            .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
        asked = short.filter(~free).select(qid, "_n", F.explode(F.array_distinct("_tags")).alias("_tag"))
        offered = offered.unionByName(asked.join(per_tag, "_tag").select(qid, "_n", pid).distinct())
    more = offered.join(ranked.select(qid, pid), [qid, pid], "left_anti")
    place = F.col("_n") + F.row_number().over(Window.partitionBy(qid).orderBy(pid))
    more = more.withColumn("rank", place).filter(F.col("rank") <= k)
    kinds = {f.name: f.dataType for f in ranked.schema.fields}
    return ranked.unionByName(more.select(qid, F.col(pid).cast(kinds[pid]).alias(pid), F.lit(0.0).alias("sim"),
                                          F.col("rank").cast("int").alias("rank")))


# Scores are compared after rounding; bounds leave this much room for it.
_ROUNDING = 1e-6


def _stacked(postings: DataFrame, fields: list[str], weights: dict[str, float], pid: str) -> DataFrame:
    """(id, field, term, w) of one vector per post: the unit vectors of its
    fields side by side, each scaled so that a dot product of two such vectors
    is the weighted sum of the fields' cosines."""
    scale = F.create_map(*[x for f in fields for x in (F.lit(f), F.lit(float(weights[f]) ** 0.5))])
    return postings.filter(F.col("field").isin(*fields)).select(
        F.col(pid).alias("id"), "field", "term", (F.col("weight") * scale[F.col("field")]).alias("w"))


def indexed_part(vectors: DataFrame, t: float) -> DataFrame:
    """The postings (id, field, term, w, rest, left_out) that an all-pairs join
    over the threshold needs.

    Each vector's terms are ordered from frequent to rare; ``rest`` is the norm
    of those before a term.  While the norm up to and with a term stays below
    t / (the largest norm of any vector), these terms alone cannot make a score
    of t with any vector, so they are left out (``left_out``: their norm).  Of
    two vectors that score t, the part that is left out further towards the rare
    end cannot hold all common terms: a term that is kept in both is shared."""
    df = vectors.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    v = vectors.join(checked_broadcast(df), ["field", "term"])
    order = Window.partitionBy("id").orderBy(F.desc("df"), "field", "term")
    upto = F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    v = materialize(v.withColumn("upto", upto))
    most = v.agg(F.max("upto")).first()[0] or 1.0
    limit = max(0.0, t - _ROUNDING) ** 2 / most
    out = F.max(F.when(F.col("upto") < limit, F.col("upto"))).over(Window.partitionBy("id"))
    kept = v.withColumn("left_out", F.sqrt(F.coalesce(out, F.lit(0.0)))).filter(F.col("upto") >= limit)
    # a term of one vector can meet no other
    return kept.filter("df > 1").select("id", "field", "term", "w", "left_out",
                                        F.sqrt(F.greatest(F.col("upto") - F.col("w") * F.col("w"), F.lit(0.0))).alias("rest"))


# Bytes and posts of a block whose pairs a task scores, and what it holds of their
# scores and common terms at a time.
BLOCK_BYTES, BLOCK_POSTS = 64 << 20, 4096
SCORE_BYTES, MATCHES, COLUMNS = 16 << 20, 1 << 20, 256
# Share of the pairs that meet at a term from which a matrix product is cheaper
# than adding them up one by one.
DENSE_SHARE = 0.01


def _entries(frame: pd.DataFrame, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, weight, row) of some posts, by term."""
    terms = list(frame["terms"][rows])
    t, w = np.concatenate(terms), np.concatenate(list(frame["weights"][rows]))
    order = np.argsort(t, kind="stable")
    return t[order], w[order], np.repeat(np.arange(len(terms)), [len(x) for x in terms])[order]


def _columns(entries: tuple, lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """The posts' weights of some terms, whose entries lie from ``lo`` to ``hi``."""
    count = hi - lo
    at = np.arange(count.sum()) + np.repeat(lo - (np.cumsum(count) - count), count)
    out = np.zeros((n, len(lo)))
    np.add.at(out, (entries[2][at], np.repeat(np.arange(len(lo)), count)), entries[1][at])
    return out


def block_scores(a: tuple, n: int, b: tuple, m: int) -> np.ndarray:
    """(n, m): the dot products of two sets of posts, as ``_entries``.  Terms that
    many pairs share are multiplied as matrices, ``COLUMNS`` at a time; of the
    others the common entries are added up, ``MATCHES`` at a time."""
    terms, first = np.unique(a[0], return_index=True)
    last = np.append(first[1:], len(a[0]))
    lo, hi = np.searchsorted(b[0], terms, "left"), np.searchsorted(b[0], terms, "right")
    often = (last - first) * (hi - lo) >= DENSE_SHARE * n * m
    out = np.zeros((n, m))
    dense = np.flatnonzero(often & (hi > lo))
    for i in range(0, len(dense), COLUMNS):
        c = dense[i:i + COLUMNS]
        out += _columns(a, first[c], last[c], n) @ _columns(b, lo[c], hi[c], m).T
    term = np.repeat(np.arange(len(terms)), last - first)
    met = np.flatnonzero(~often[term] & (hi > lo)[term])
    base, weight, start, count = a[2][met] * m, a[1][met], lo[term[met]], (hi - lo)[term[met]]
    flat, ends, i = out.reshape(-1), np.cumsum(count), 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - count[i] + MATCHES, "right")))
        c = count[i:j]
        at = np.arange(c.sum()) + np.repeat(start[i:j] - (np.cumsum(c) - c), c)
        flat += np.bincount(np.repeat(base[i:j], c) + b[2][at], np.repeat(weight[i:j], c) * b[1][at], n * m)
        i = j
    return out


def _pairs_over(low: float):
    """The pairs of a block pair that score ``low`` at least, the smaller id first."""
    def fn(key: tuple, posts: pd.DataFrame) -> pd.DataFrame:
        one, other = (posts[posts["own"] == k].reset_index(drop=True) for k in key)
        found = [pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "score": np.empty(0)})]
        if len(one) and len(other):
            x, y, m = one["id"].to_numpy(np.int64), other["id"].to_numpy(np.int64), len(other)
            b, step = _entries(other, slice(None)), max(1, SCORE_BYTES // (8 * m))
            for i in range(0, len(one), step):
                rows = slice(i, i + step)
                s = block_scores(_entries(one, rows), len(x[rows]), b, m)
                r, c = np.nonzero(s >= low)
                p, q, s = x[rows][r], y[c], s[r, c]
                # inside a block every pair is met from both ends
                once = p < q if key[0] == key[1] else p != q
                found.append(pd.DataFrame({"a": np.minimum(p, q)[once], "b": np.maximum(p, q)[once], "score": s[once]}))
        return pd.concat(found)
    return fn


def threshold_join_sparse(postings: DataFrame, t: float, fields: list[str] | None = None, mean: bool = True,
                          qid: str = "query_id", pid: str = "post_id", round_to: int = 6,
                          block_bytes: int = BLOCK_BYTES, block_posts: int = BLOCK_POSTS) -> DataFrame:
    """J11 (sparse): all pairs of different posts, in both directions, whose
    cosine (mean over the fields, or summed) exceeds ``t`` > 0 after rounding.

    Posts (one row each, their terms as numbers) are cut into blocks that meet
    pair by pair, where numpy scores them: only the pairs that exceed the
    threshold leave a task, and what is shuffled grows with the posts and their
    blocks, not with the pairs that share a term.  Ids are whole numbers."""
    if t <= 0:
        raise ValueError("the threshold must be positive: pairs without a common term score 0")
    fields = fields or ["title", "body"]
    v = materialize(_stacked(postings, fields, {f: 1 / len(fields) if mean else 1.0 for f in fields}, pid).filter("id is not null"))
    # a term of one vector can meet no other
    common = v.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("term").distinct()
    numbers = materialize(common.withColumn("no", F.monotonically_increasing_id()))
    place = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field")) - 1
    known = lookup(v, numbers, "term").filter("no is not null")
    each = known.select(F.col("id").cast("long").alias("id"),
                        F.struct((F.col("no") * len(fields) + place).alias("t"), "w").alias("x"))
    rows = materialize(each.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("l"))
                       .select("id", F.col("l.t").alias("terms"), F.col("l.w").alias("weights")))
    n, entries = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = block_count(n, max(16, min(block_posts, block_bytes // (16 * (entries // max(1, n) + 1)))))
    met = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) \
        .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    pairs = met.groupBy("i", "j").applyInPandas(_pairs_over(t - _ROUNDING), "a long, b long, score double")
    scored = pairs.select("a", "b", F.round("score", round_to).alias("sim")).filter(F.col("sim") > t)
    return scored.select(F.inline(F.array(F.struct(F.col("a").alias(qid), F.col("b").alias(pid), "sim"),
                                          F.struct(F.col("b").alias(qid), F.col("a").alias(pid), "sim"))))
