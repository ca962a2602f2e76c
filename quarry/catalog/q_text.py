"""Checked queries: text operators over whole documents, pages and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from .. import oracle_text as S
from ..functions import text as T
from ..operators import filters
from ..resources import stop_words
from ..sources import qa_model as M
from . import register


def _docs(spark, sf):
    return M.table(spark, sf, "documents")


def _doc_sql(expr: str, out: str = "out") -> str:
    return f"SELECT doc_id, {expr} AS {out} FROM documents"


def _col(name, spark_fn, sql_expr):
    """Register a per-document text column query."""
    register(name, _doc_sql(sql_expr))(
        lambda spark, sf: _docs(spark, sf).select("doc_id", spark_fn(F.col("text")).alias("out")))


_col("t5_strip_separators", T.strip_separators, S.strip_separators("text"))
_col("t6_squeeze_whitespace", T.squeeze_whitespace, S.squeeze_whitespace("text"))
_col("t9_remove_stacktraces", T.remove_stacktraces, S.remove_stacktraces("text"))
_col("t10_remove_long_strings", T.remove_long_strings, S.remove_long_strings("text"))
_col("t11_normalize_symbols", T.normalize_symbols, S.normalize_symbols("text"))
_col("t12_remove_paths", T.remove_paths, S.remove_paths("text"))
_col("t12_remove_large_tokens", T.remove_large_tokens, S.remove_large_tokens("text"))
_col("t32_clean_comment_quotes", T.clean_comment_quotes, S.clean_comment_quotes("text"))
_col("t20_emoticon_label", T.emoticon_label, S.emoticon_label("text"))
_col("t14_normalize_text", T.normalize_text, S.normalize_text("text"))
_col("t16_normalize_query", T.normalize_query, S.normalize_text("text", keep_urls=True))


@register("t1_html_to_text",
          f"SELECT page_id, {S.html_to_text('html')} AS text FROM pages")
def t1_html_to_text(spark, sf):
    return M.table(spark, sf, "pages").select("page_id", T.html_to_text("html").alias("text"))


@register("t2_drop_code_blocks", O.with_ctes(
    f"SELECT answer_id, {S.drop_code_blocks('body')} AS out FROM answers", "answers"))
def t2_drop_code_blocks(spark, sf):
    return M.answers(spark, sf).select("answer_id", T.drop_code_blocks("body").alias("out"))


@register("t7_word_punct_counts", _doc_sql(
    f"CAST({S.word_count('text')} AS INTEGER) AS words, "
    f"CAST({S.punct_count('text')} AS INTEGER)", "punct"))
def t7_word_punct_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", T.word_count("text").alias("words"),
                                   T.punct_count("text").cast("int").alias("punct"))


@register("t8_line_quality", _doc_sql(f"round({S.line_quality('text')}, 6)", "quality"))
def t8_line_quality(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(T.line_quality("text"), 6).alias("quality"))


@register("f8_filter_low_quality",
          f"SELECT page_id FROM pages WHERE {S.keep_by_quality(S.html_to_text('html'))}")
def f8_filter_low_quality(spark, sf):
    p = M.table(spark, sf, "pages").select("page_id", T.html_to_text("html").alias("text"))
    return filters.filter_low_quality(p, "text").select("page_id")


def _tok_sql(arr: str) -> str:
    return (f"CAST(len({arr}) AS INTEGER) AS n_tokens, array_to_string({arr}, ' ') AS tokens")


@register("t13_tokenize_software_text",
          _doc_sql(_tok_sql(S.tokenize_software_text("text")).replace(" AS tokens", ""), "tokens"))
def t13_tokenize(spark, sf):
    a = T.tokenize_software_text("text")
    return _docs(spark, sf).select("doc_id", F.size(a).alias("n_tokens"),
                                   F.array_join(a, " ").alias("tokens"))


@register("t19_social_tokenize",
          _doc_sql(_tok_sql(S.social_tokenize("text")).replace(" AS tokens", ""), "tokens"))
def t19_social_tokenize(spark, sf):
    a = T.social_tokenize("text")
    return _docs(spark, sf).select("doc_id", F.size(a).alias("n_tokens"),
                                   F.array_join(a, " ").alias("tokens"))


@register("t21_split_sentences",
          "SELECT doc_id, CAST(s.pos AS INTEGER) AS pos, s.sentence FROM documents, "
          f"LATERAL (SELECT unnest(generate_series(1, len(arr))) AS pos, unnest(arr) AS sentence "
          f"FROM (SELECT {S.split_sentences('text')} AS arr)) s")
def t21_split_sentences(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", F.posexplode(T.split_sentences("text")).alias("pos", "sentence")) \
            .select("doc_id", (F.col("pos") + 1).cast("int").alias("pos"), "sentence")


_SW = ", ".join(S.q(w) for w in stop_words())


@register("t22_remove_stop_words", _doc_sql(
    "array_to_string(list_filter(string_split(lower(text), ' '), lambda t: "
    f"NOT list_contains([{_SW}], lower(t)) AND NOT regexp_matches(t, '^[0-9]+$') "
    "AND length(t) > 1), ' ')", "kept"))
def t22_remove_stop_words(spark, sf):
    toks = F.split(F.lower("text"), " ")
    return _docs(spark, sf).select(
        "doc_id", F.array_join(T.remove_stop_words(toks, stop_words()), " ").alias("kept"))


@register("t23_parse_tags", O.with_ctes(
    f"SELECT post_id, array_to_string({S.parse_tags('tags')}, ',') AS tag_list, "
    f"CAST(len({S.parse_tags('tags')}) AS INTEGER) AS n_tags FROM questions", "questions"))
def t23_parse_tags(spark, sf):
    a = T.parse_tags("tags")
    return M.questions(spark, sf).select("post_id", F.array_join(a, ",").alias("tag_list"),
                                         F.size(a).alias("n_tags"))


@register("t30_classifier_tokens", _doc_sql(
    f"array_to_string({S.classifier_tokens('text')}, ' ')", "tokens"))
def t30_classifier_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id",
                                   F.array_join(T.classifier_tokens("text"), " ").alias("tokens"))
