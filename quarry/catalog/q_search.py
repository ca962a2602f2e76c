"""Checked queries: sparse model and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ..operators import sparse
from ..plans import search
from ..sources import qa_model as M
from . import register


@register("p1_sparse_search", O.with_ctes(
    "SELECT r.query_id, r.rank, r.post_id, r.sim, q.title FROM ("
    + O.ranked("sparse_all", 10) + ") r JOIN questions q USING (post_id)",
    "sparse_all", "questions"))
def p1_sparse_search(spark, sf):
    return search.sparse_search(M.questions(spark, sf), M.search_queries(spark, sf), k=10)


@register("a8_document_frequencies", O.with_ctes(
    "SELECT term, df, round(idf, 6) AS idf FROM idf", "idf"))
def a8(spark, sf):
    idf, _ = search.build_sparse_index(M.questions(spark, sf))
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


@register("v4_tfidf_transform", O.with_ctes(
    "SELECT post_id, field, term, round(weight, 6) AS weight FROM postings", "postings"))
def v4(spark, sf):
    _, postings = search.build_sparse_index(M.questions(spark, sf))
    return postings.select("post_id", "field", "term", F.round("weight", 6).alias("weight"))


@register("v13_sparse_query_vectors", O.with_ctes(
    "SELECT query_id, term, round(weight, 6) AS weight FROM qpost", "qpost"))
def v13(spark, sf):
    idf, _ = search.build_sparse_index(M.questions(spark, sf))
    qv = search.sparse_query_vectors(idf, M.search_queries(spark, sf))
    return qv.select("query_id", "term", F.round("weight", 6).alias("weight"))


@register("j10_knn_join_sparse", O.with_ctes(O.ranked("sparse_scores", 20), "sparse_scores"))
def j10(spark, sf):
    idf, postings = search.build_sparse_index(M.questions(spark, sf))
    qv = search.sparse_query_vectors(idf, M.search_queries(spark, sf))
    return sparse.knn_join_sparse(qv, postings, 20)


@register("v10_score_fields_weighted", O.with_ctes(O.ranked(
    "(SELECT query_id, post_id, round(sum(q.weight * p.weight * CASE WHEN p.field = 'title' "
    "THEN 0.3 ELSE 0.7 END), 6) AS sim FROM qpost q JOIN postings p USING (term) GROUP BY ALL)", 10),
    "qpost", "postings"))
def v10(spark, sf):
    idf, postings = search.build_sparse_index(M.questions(spark, sf))
    qv = search.sparse_query_vectors(idf, M.search_queries(spark, sf))
    return sparse.knn_join_sparse(qv, postings, 10, weights=search.check_weights(
        {"title": 0.3, "body": 0.7}, ["title", "body"]))


@register("a16_field_counts", O.with_ctes(
    "SELECT field, count(*) AS n_rows, count(DISTINCT post_id) AS n_posts FROM postings GROUP BY field",
    "postings"))
def a16(spark, sf):
    from ..operators.relational import field_counts
    _, postings = search.build_sparse_index(M.questions(spark, sf))
    return field_counts(postings)


@register("t25_parse_user_tags",
          "SELECT item_id, array_to_string(list_distinct_ordered, ',') AS tags FROM (SELECT item_id, "
          "list_filter(list_transform(string_split_regex(lower(text), '[,;\\s]+'), "
          "lambda x: trim(x)), lambda x: x <> '') AS l FROM benchmark), "
          "LATERAL (SELECT list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered)")
def t25(spark, sf):
    from ..functions.text import parse_user_tags
    b = M.table(spark, sf, "benchmark")
    return b.select("item_id", F.array_join(parse_user_tags(F.col("text")), ",").alias("tags"))


@register("t24_parse_entities", O.with_ctes(
    "SELECT post_id, CASE WHEN len(l) = 0 THEN '<unk>' ELSE array_to_string(l, ',') END AS entities FROM "
    "(SELECT post_id, list_filter(string_split(source || '<_ent_>' || lang || '<_ent_>', '<_ent_>'), "
    "lambda x: x <> '') AS l FROM questions q JOIN documents d ON d.doc_id = q.post_id)", "questions"))
def t24(spark, sf):
    from ..functions.text import parse_entities
    d = M.table(spark, sf, "documents")
    s = F.concat(F.col("source"), F.lit("<_ent_>"), F.col("lang"), F.lit("<_ent_>"))
    return d.select(F.col("doc_id").alias("post_id"), F.array_join(parse_entities(s), ",").alias("entities"))


@register("t33_result_links", O.with_ctes(
    "SELECT answer_id, 'https://stackoverflow.com/a/' || CAST(answer_id AS VARCHAR) AS link, "
    "'// answer ' || CAST(answer_id AS VARCHAR) || ', score ' || CAST(score AS VARCHAR) AS header "
    "FROM answers", "answers"))
def t33(spark, sf):
    from ..functions.text import answer_link, snippet_header
    a = M.answers(spark, sf)
    return a.select("answer_id", answer_link("answer_id").alias("link"),
                    snippet_header("answer_id", "score").alias("header"))
