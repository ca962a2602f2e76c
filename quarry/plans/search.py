"""P1/P2 batch search: a table of queries against the index tables.

"Search" is a batch query join: (queries x index) -> ranked rows.  A single
interactive query is the one-row case of the same plan.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sparse
from .strategy import checked_broadcast, materialize


def stack_fields(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """Wide (id, title, body, ...) -> long (id, field, text), from one scan of
    the input (an inline generator, not a union of per-field scans)."""
    arr = F.array(*[F.struct(F.lit(name).alias("field"), F.col(col).cast("string").alias("text"))
                    for name, col in fields.items()])
    return df.select(F.col(id_col), F.inline(arr))


def build_sparse_index(questions: DataFrame, fields: dict[str, str] | None = None,
                       fit_field: str = "body", id_col: str = "post_id"):
    """V9 (sparse): fit idf on one field, transform every field.

    Returns (idf, postings(post_id, field, term, weight)).
    """
    fields = fields or {"title": "title", "body": "body"}
    # The idf is read by the postings and by the queries: materialised once.
    # The fit field is tokenised twice (idf fit, postings) on purpose: keeping
    # the term counts lazy keeps them hash-partitioned by post_id, so the norm
    # window and the per-(query, post) sum need no further shuffle; a
    # materialised copy would lose that partitioning and add two exchanges of
    # postings-sized data, which costs more than re-running the tokenizer.
    idf = materialize(sparse.tfidf_fit(questions.select(id_col, F.col(fields[fit_field]).alias("text")),
                                       id_col, "text"))
    long = stack_fields(questions, id_col, fields)
    postings = sparse.tfidf_transform(idf, long, id_col, "text", "field")
    return idf, postings


def sparse_query_vectors(idf: DataFrame, queries: DataFrame, qid: str = "query_id",
                         text_col: str = "text") -> DataFrame:
    """V13 (sparse): queries -> unit tf-idf postings (query_id, term, weight)."""
    tf = materialize(sparse.term_counts(queries.select(qid, text_col), qid, text_col))
    known = idf.join(checked_broadcast(tf.select("term").distinct()), "term", "left_semi")
    return sparse.postings_from_counts(tf, known, [qid])


def sparse_search(questions: DataFrame, queries: DataFrame, k: int = 10,
                  weights: dict | None = None,
                  ranking: Callable[[DataFrame], DataFrame] | None = None,
                  on_results: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """P1 (sparse): ranked (query_id, rank, post_id, sim, title), min(k, posts)
    rows per query: posts without a common term follow by id, with score 0.

    ``ranking`` (U1) replaces the default top-k ranking over the scored pairs
    (and is not completed); ``on_results`` (U2) is applied to the final result
    DataFrame.
    """
    if weights is not None:
        check_weights(weights, FIELDS)
    idf, postings = build_sparse_index(questions)
    qv = sparse_query_vectors(idf, queries)
    if ranking is None:
        ranked = sparse.knn_join_sparse(qv, postings, k, weights=weights)
        ranked = sparse.fill_to_k(ranked, queries, questions, k)
    else:
        scored = sparse.knn_join_sparse(qv, postings, None, weights=weights)
        ranked = ranking(scored.drop("rank"))
    out = ranked.join(questions.select("post_id", "title"), "post_id")
    out = out.select("query_id", "rank", "post_id", "sim", "title")
    return on_results(out) if on_results else out


# ------------------------------------------------------------------ dense / hybrid
from ..operators import dense  # noqa: E402

FIELDS = ["title", "body"]
# Scores are compared after rounding; bounds leave this much room for it.
_ROUNDING = 1e-6


def build_dense_index(questions: DataFrame, word_vectors: DataFrame,
                      fields: dict[str, str] | None = None, id_col: str = "post_id",
                      oov: str = "unk") -> DataFrame:
    """V8/V9 (dense): (post_id, field, vector) mean unit word vectors."""
    long = stack_fields(questions, id_col, fields or {"title": "title", "body": "body"})
    return dense.doc_vectors(long, word_vectors, id_col, "text", "field", oov=oov)


def dense_query_vectors(queries: DataFrame, word_vectors: DataFrame, fields=FIELDS,
                        qid: str = "query_id") -> DataFrame:
    """V13 (dense): one query vector, repeated for every index field."""
    v = dense.doc_vectors(queries.select(qid, "text"), word_vectors, qid, "text", None)
    parts = [v.select(qid, F.lit(f).alias("field"), "vector") for f in fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dense_search(questions: DataFrame, queries: DataFrame, word_vectors: DataFrame,
                 k: int = 10, weights: dict | None = None) -> DataFrame:
    """P1 (dense): ranked (query_id, rank, post_id, sim, title)."""
    if weights is not None:
        check_weights(weights, FIELDS)
    word_vectors = materialize(word_vectors)
    index = build_dense_index(questions, word_vectors)
    qv = dense_query_vectors(queries, word_vectors)
    ranked = dense.knn_join_dense(qv, index, k, FIELDS, weights=weights)
    return ranked.join(questions.select("post_id", "title"), "post_id") \
        .select("query_id", "rank", "post_id", "sim", "title")


def hybrid_scores(qv_dense: DataFrame, index_dense: DataFrame, qv_sparse: DataFrame,
                  postings: DataFrame, k: int, mean: bool = False,
                  fields=FIELDS, meta: DataFrame | None = None,
                  query_tags: DataFrame | None = None, ranked: bool = True,
                  weights: dict | None = None) -> DataFrame:
    """Exact top-k of dense_sum + sparse_sum; ``weights`` (field ->
    weight) scale the fields of both halves.

    Sparse weights are non-negative, so a pair without term overlap can only
    enter the hybrid top-k if it is in the dense top-k.  The best k of the dense
    and the sparse top-k together give each query a score that its k-th hybrid
    score is not below; with the query's largest dense score, that is the sparse
    score which any further pair must reach.  Only such pairs get their dense
    score (equi-joins on ids); a query whose two lists hold fewer than k posts
    keeps all its pairs.  The concatenated unit vectors are built once and serve
    both the block k-NN and the candidate scoring.

    With ``meta`` and ``query_tags`` only posts of the queries' tags are
    candidates."""
    qcat = materialize(dense.field_concat(qv_dense.withColumnRenamed("query_id", "qid"), "qid", fields, weights))
    dcat = materialize(dense.field_concat(index_dense.withColumnRenamed("post_id", "pid"), "pid", fields))
    qk, dk = qcat, dcat
    tagged = query_tags is not None and meta is not None
    if tagged:
        # dense top-k among each query's allowed posts (tag mask in the kernel)
        qk = qcat.join(query_tags.select(F.col("query_id").alias("qid"), "tags"), "qid", "left")
        dk = dcat.join(meta.select(F.col("post_id").alias("pid"), F.col("etags").alias("tags")), "pid", "left")
    dtop = materialize(dense.knn_join_vectors(qk, dk, k).select(
        F.col("qid").alias("query_id"), F.col("pid").alias("post_id"), F.col("sim").alias("d_sim")))
    sp = sparse.knn_join_sparse(qv_sparse, postings, None, round_to=12, weights=weights)
    if tagged:
        sp = tag_filter(sp, query_tags.distinct(), meta.select("post_id", "etags").distinct())
    sp = materialize(sp.select("query_id", "post_id", F.col("sim").alias("s_sim")))

    def scored(cands: DataFrame) -> DataFrame:
        """The hybrid scores, not rounded, of (query_id, post_id, s_sim)."""
        j = (cands.join(checked_broadcast(qcat.select(F.col("qid").alias("query_id"), F.col("vec").alias("qv"))), "query_id", "left")
             .join(dcat.select(F.col("pid").alias("post_id"), F.col("vec").alias("dv")), "post_id", "left"))
        total = F.coalesce(dense.dot("qv", "dv"), F.lit(0.0)) + F.coalesce("s_sim", F.lit(0.0))
        return j.select("query_id", "post_id", total.alias("total"))

    s_top = sparse.rank_results(sp.withColumnRenamed("s_sim", "sim"), k).select("query_id", "post_id")
    first = materialize(dtop.select("query_id", "post_id").unionByName(s_top).distinct()
                        .join(sp, ["query_id", "post_id"], "left"))
    best = sparse.rank_results(scored(first).withColumnRenamed("total", "sim"), k)
    kth = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("sim").alias("_kth"))
    # a post without a vector has a dense score of 0
    most = dtop.groupBy("query_id").agg(F.greatest(F.max("d_sim"), F.lit(0.0)).alias("_most"))
    room = _ROUNDING * (2 + 2 * len(fields))
    need = kth.filter(F.col("_n") >= k).join(most, "query_id").select(
        "query_id", (F.col("_kth") - F.col("_most") - room).alias("_need"))
    more = sp.join(checked_broadcast(need), "query_id", "left") \
        .filter(F.col("_need").isNull() | (F.col("s_sim") >= F.col("_need"))).drop("_need")
    cands = more.join(first.select("query_id", "post_id"), ["query_id", "post_id"], "left_anti").unionByName(first)
    # of a query that is given twice, the dense results stand twice
    cands = cands.join(dtop.select("query_id", "post_id"), ["query_id", "post_id"], "left")
    total = F.col("total") / (2.0 * len(fields)) if mean else F.col("total")
    scores = scored(cands).select("query_id", "post_id", F.round(total, 6).alias("sim"))
    return sparse.rank_results(scores, k) if ranked else scores


def hybrid_search(questions: DataFrame, queries: DataFrame, word_vectors: DataFrame,
                  k: int = 10, mean: bool = False, weights: dict | None = None) -> DataFrame:
    """P1 (hybrid)."""
    if weights is not None:
        check_weights(weights, FIELDS)
    idf, postings = build_sparse_index(questions)
    qs = sparse_query_vectors(idf, queries)
    word_vectors = materialize(word_vectors)
    index = build_dense_index(questions, word_vectors)
    qd = dense_query_vectors(queries, word_vectors)
    ranked = hybrid_scores(qd, index, qs, postings, k, mean, weights=weights)
    return ranked.join(questions.select("post_id", "title"), "post_id") \
        .select("query_id", "rank", "post_id", "sim", "title")


def rerank(questions: DataFrame, queries: DataFrame, word_vectors: DataFrame,
           first_k: int = 200, k: int = 20, fields=FIELDS) -> DataFrame:
    """Sparse first stage (top first_k) re-scored by dense similarity, top k."""
    idf, postings = build_sparse_index(questions)
    first = materialize(sparse.knn_join_sparse(sparse_query_vectors(idf, queries), postings, first_k)
                        .select("query_id", "post_id"))
    # vectors of the first stage's posts only
    wanted = questions.join(first.select("post_id").distinct(), "post_id", "left_semi")
    word_vectors = materialize(word_vectors)
    index = build_dense_index(wanted, word_vectors)
    qd = dense_query_vectors(queries, word_vectors)
    qcat = dense.field_concat(qd, "query_id", fields).withColumnRenamed("vec", "qv")
    dcat = dense.field_concat(index, "post_id", fields).withColumnRenamed("vec", "dv")
    j = first.select("query_id", "post_id").join(qcat, "query_id").join(dcat, "post_id")
    scores = j.select("query_id", "post_id", F.round(dense.dot("qv", "dv"), 6).alias("sim"))
    return sparse.rank_results(scores, k)


def metadata_frame(ranked: DataFrame, meta: DataFrame) -> DataFrame:
    """Ranked rows + title, snippet count, best snippet, link, similarity
    rounded to 4 places and a JSON record per row (T33, T34, W4)."""
    from ..functions import text as T
    best = F.col("best")
    j = ranked.join(meta.select("post_id", "title", "snippet_count", "best"), "post_id")
    return j.select(
        "query_id", "rank", "post_id", "title", F.round("sim", 4).alias("sim"), "snippet_count",
        T.result_link("post_id").alias("link"),
        F.array_join(best["code"], "\n\n").alias("best_snippet"),
        T.results_to_json("query_id", "rank", "post_id").alias("json"))


def check_weights(weights: dict, fields: list[str], tol: float = 1e-9) -> dict:
    """Field weights must name exactly the index fields and sum to 1 (within
    a tolerance, not exact float equality)."""
    if set(weights) != set(fields):
        raise ValueError(f"weights {sorted(weights)} do not match fields {sorted(fields)}")
    if abs(sum(weights.values()) - 1.0) > tol:
        raise ValueError("field weights must sum to 1")
    return weights


def tag_filter(scores: DataFrame, queries: DataFrame, meta: DataFrame,
               qid: str = "query_id", tags_col: str = "tags") -> DataFrame:
    """F9 inside search: keep a scored (query, post) pair when the post's
    etags overlap the query's tags.  Queries without tags are not filtered;
    unknown tags never match, so a query whose tags are all unknown gets no
    results.  Applied to the scored pairs before ranking (filtering commutes
    with the order), via a join on post_id with the metadata — no tag x query
    pair table is built."""
    qt = queries.select(qid, F.col(tags_col).alias("_qt"))
    j = scores.join(qt, qid, "left").join(meta.select("post_id", "etags"), "post_id", "left")
    keep = (F.col("_qt").isNull() | (F.size("_qt") == 0)
            | F.coalesce(F.arrays_overlap("etags", "_qt"), F.lit(False)))
    return j.filter(keep).drop("_qt", "etags")


def search(questions: DataFrame, queries: DataFrame, meta: DataFrame, model: str = "sparse",
           k: int = 10, word_vectors: DataFrame | None = None, weights: dict | None = None,
           n_top_tags: int = 8, stored: str | None = None):
    """Batch search.  ``queries`` (query_id, text[, tags array]); model
    'sparse', 'dense' or 'hybrid'.  Returns (ranked rows with metadata (P2),
top tags per query (A7)).  ``stored`` names the folder of an index that was
    built before; without it the index is built from ``questions``.

    Over a stored index, queries without tags read what can still win only: the
    blocks of postings and the cells of vectors whose bounds allow it."""
    from ..operators import blockmax, cells
    from ..operators.relational import top_tags
    spark = queries.sparkSession
    has_tags = "tags" in queries.columns
    if weights is not None:
        check_weights(weights, FIELDS)
    postings = maxima = None
    if model in ("sparse", "hybrid"):
        if stored:
            idf = spark.read.parquet(f"{stored}/idf")
            qs = sparse_query_vectors(idf, queries)
            postings, maxima = blockmax.read_postings(spark, f"{stored}/sparse", qs)
        else:
            idf, postings = build_sparse_index(questions)
            qs = sparse_query_vectors(idf, queries)
    if model in ("dense", "hybrid"):
        word_vectors = materialize(word_vectors)
        index = spark.read.parquet(f"{stored}/dense").select("post_id", "field", "vector") if stored \
            else build_dense_index(questions, word_vectors)
        qd = dense_query_vectors(queries, word_vectors)
        qtags = queries.select("query_id", "tags") if has_tags else None
    if model == "sparse":
        if stored and not has_tags:
            scores = blockmax.search_blocks(qs, postings, maxima, k, weights).drop("rank")
        else:
            scores = sparse.knn_join_sparse(qs, postings, None, weights=weights)
    elif model == "dense":
        if stored and not has_tags:
            qv = dense.field_concat(qd.withColumnRenamed("query_id", "qid"), "qid", FIELDS, weights)
            top = cells.search_cells(spark, f"{stored}/dense_cells", qv, k)
            scores = top.select(F.col("qid").alias("query_id"), F.col("pid").alias("post_id"), "sim")
        else:
            scores = dense_topk_tagged(qd, index, k, meta, qtags, weights).drop("rank")
    elif model == "hybrid":
        scores = hybrid_scores(qd, index, qs, postings, k, meta=meta, query_tags=qtags, ranked=False, weights=weights)
    else:
        raise ValueError(f"unknown model {model!r}")
    if has_tags:
        scores = tag_filter(scores, queries, meta)
    ranked = sparse.rank_results(scores, k)
    if model == "sparse":
        ranked = sparse.fill_to_k(ranked, queries, meta, k, tags_col="tags" if has_tags else None)
    return metadata_frame(ranked, meta), top_tags(ranked, meta, n_top_tags)


def dense_topk_tagged(qd: DataFrame, index: DataFrame, k: int, meta: DataFrame | None = None,
                      query_tags: DataFrame | None = None, weights: dict | None = None) -> DataFrame:
    """Dense exact top-k per query among the posts whose etags overlap the
    query's tags (mask applied inside the k-NN kernel, before the local
    top-k; queries without tags are unfiltered)."""
    qv = dense.field_concat(qd.withColumnRenamed("query_id", "qid"), "qid", FIELDS, weights)
    iv = dense.field_concat(index.withColumnRenamed("post_id", "pid"), "pid", FIELDS)
    if query_tags is not None and meta is not None:
        qv = qv.join(query_tags.select(F.col("query_id").alias("qid"), "tags"), "qid", "left")
        iv = iv.join(meta.select(F.col("post_id").alias("pid"), F.col("etags").alias("tags")), "pid", "left")
    r = dense.knn_join_vectors(qv, iv, k)
    return r.select(F.col("qid").alias("query_id"), F.col("pid").alias("post_id"), "sim", "rank")


def search_stored(spark, index_dir: str, queries: DataFrame, model: str = "sparse", k: int = 10,
                  word_vectors: DataFrame | None = None, weights: dict | None = None, n_top_tags: int = 8):
    """P1 over an index that the index job (P7) wrote: nothing is rebuilt, and
    of the postings only the buckets that hold terms of the queries are read."""
    meta = spark.read.parquet(f"{index_dir}/metadata")
    return search(None, queries, meta, model, k, word_vectors, weights, n_top_tags, index_dir)
