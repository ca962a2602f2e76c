"""Checked queries for rows otherwise covered only inside larger plans:
V3 (fit on its own table), V7, W1, T34, P9, U1/U2."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ..functions import text as T
from ..operators import dense as D
from ..operators import snippets as SN
from ..operators import sparse as SP
from ..plans import search
from ..session import scratch_path
from ..sources import files
from ..sources import qa_model as M
from . import register
from . import q_relational  # noqa: F401  (enriched CTE)


@register("v3_tfidf_fit", f"""
    SELECT term, count(*) AS df, round(ln((1.0 + (SELECT count(*) FROM documents)) / (count(*) + 1.0)) + 1.0, 6) AS idf
    FROM (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text),
          '{O.TOKEN_RE}')) AS term FROM documents) WHERE term NOT IN {O.STOP_SQL}) GROUP BY term""")
def v3(spark, sf):
    idf = SP.tfidf_fit(M.table(spark, sf, "documents"), "doc_id", "text")
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


@register("v7_build_glove_model", O.with_ctes(
    "SELECT token, round(f0 / sqrt(" + " + ".join(f"f{i} * f{i}" for i in range(8)) + "), 6) AS u0 FROM ("
    "SELECT token, " + ", ".join(f"CAST(CAST(v{i} AS FLOAT) AS DOUBLE) AS f{i}" for i in range(8))
    + " FROM wv WHERE token <> '<unk>')",
    "wv"))
def v7(spark, sf):
    """Vector file (S4) -> unit-normalised model (V2): write the fixture
    vectors, read them back, normalise."""
    wv = M.word_vectors(spark, sf).filter(F.col("token") != "<unk>").select(
        "token", F.transform("vector", lambda x: x.cast("float")).alias("vector"))
    path = scratch_path(spark, "glove")
    files.write_word_vectors(wv, path)
    model = files.read_word_vectors(spark, path).select(
        "token", D.unit_normalize(F.transform("vector", lambda x: x.cast("double"))).alias("u"))
    return model.select("token", F.round(F.col("u")[0], 6).alias("u0"))


@register("w1_rank_results", O.with_ctes(O.ranked("sparse_scores", 3), "sparse_scores"))
def w1(spark, sf):
    idf, postings = search.build_sparse_index(M.questions(spark, sf))
    qv = search.sparse_query_vectors(idf, M.search_queries(spark, sf))
    scores = SP.knn_join_sparse(qv, postings, None).drop("rank")
    return SP.rank_results(scores, 3)


@register("t34_results_to_json", O.with_ctes(
    "SELECT query_id, rank, CAST(to_json({'query_id': query_id, 'rank': rank, 'post_id': post_id}) AS VARCHAR) AS json "
    "FROM (" + O.ranked("sparse_all", 5) + ")", "sparse_all"))
def t34(spark, sf):
    r = search.sparse_search(M.questions(spark, sf), M.search_queries(spark, sf), k=5)
    return r.select("query_id", "rank", T.results_to_json("query_id", "rank", "post_id").alias("json"))


@register("p9_snippet_pipeline", O.with_ctes(
    "SELECT post_id, snippet_count, best.answer_id AS best_answer FROM enriched", "enriched"))
def p9(spark, sf):
    e = SN.snippet_pipeline(M.questions(spark, sf), M.answers(spark, sf))
    return e.select("post_id", "snippet_count", F.col("best.answer_id").alias("best_answer"))


@register("u1_u2_ranking_and_result_hooks", O.with_ctes(
    "SELECT r.query_id, r.rank, r.post_id, r.sim, q.title, CAST(length(q.title) AS INTEGER) AS title_len FROM ("
    + O.ranked("sparse_scores", 3) + ") r JOIN questions q USING (post_id)", "sparse_scores", "questions"))
def u1(spark, sf):
    """A caller-supplied ranking (here: top 3 by the default order); U2: a
    hook applied to the result DataFrame (here: adds the title length)."""
    return search.sparse_search(
        M.questions(spark, sf), M.search_queries(spark, sf), k=10,
        ranking=lambda scored: SP.rank_results(scored, 3),
        on_results=lambda res: res.withColumn("title_len", F.length("title")))


# P1 with per-query tags (F9 inside search) and top tags
O.CTES.update({
    "qtags": ("""SELECT query_id, CASE WHEN query_id % 7 = 0 THEN ['no-such-tag']
                    WHEN query_id % 3 = 0 THEN []::VARCHAR[] WHEN query_id % 2 = 0 THEN ['en']
                    ELSE ['src3', 'fr'] END AS tags FROM queries""", ("queries",)),
})


def _tagged_queries(spark, sf):
    tags = (F.when(F.col("query_id") % 7 == 0, F.array(F.lit("no-such-tag")))
            .when(F.col("query_id") % 3 == 0, F.array().cast("array<string>"))
            .when(F.col("query_id") % 2 == 0, F.array(F.lit("en")))
            .otherwise(F.array(F.lit("src3"), F.lit("fr"))))
    return M.search_queries(spark, sf).withColumn("tags", tags)


def _tagged_sql(scores_cte: str) -> str:
    filtered = (f"(SELECT s.query_id, s.post_id, s.sim FROM {scores_cte} s JOIN qtags t USING (query_id) "
                "JOIN meta m USING (post_id) WHERE len(t.tags) = 0 OR list_has_any(m.etags, t.tags))")
    return O.with_ctes(
        "SELECT query_id, rank, post_id, CAST(round(CAST(sim AS DECIMAL(18, 6)), 4) AS DOUBLE) AS sim "
        "FROM (" + O.ranked(filtered, 10) + ")", scores_cte, "qtags", "meta")


def _tagged_search(model):
    def run(spark, sf):
        from .q_relational import _meta
        res, _ = search.search(M.questions(spark, sf), _tagged_queries(spark, sf), _meta(spark, sf),
                               model=model, k=10, word_vectors=M.word_vectors(spark, sf))
        return res.select("query_id", "rank", "post_id", "sim")
    return run


register("p1_search_tags_sparse", _tagged_sql("sparse_all"))(_tagged_search("sparse"))
register("p1_search_tags_dense", _tagged_sql("dense_scores"))(_tagged_search("dense"))
register("p1_search_tags_hybrid", _tagged_sql("hybrid_scores"))(_tagged_search("hybrid"))
