"""Projection and filter operators.

All are plain predicates so Catalyst pushes them into the Parquet scan where
the columns allow it (score, answer counts, ids).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

NOISE_TITLE_WORDS = ("exception", "debug", "error", "fail", "warning")


def _any_like(col: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [col.ilike(f"%{w}%") for w in words])


def select_topic_questions(posts: DataFrame, include=("java", "swing"),
                           exclude=("javascript",), tags_col: str = "tags") -> DataFrame:
    """questions whose tag string contains any ``include`` substring and no
    ``exclude`` substring (case-insensitive, like SQL LIKE)."""
    c = F.col(tags_col)
    pred = _any_like(c, include)
    for w in exclude:
        pred = pred & ~c.ilike(f"%{w}%")
    return posts.filter(pred)


def filter_questions(questions: DataFrame, ans_count: int = 1, score: int = -3) -> DataFrame:
    """F2: corpus admission thresholds (answer_count >= n and score >= s)."""
    return questions.filter((F.col("answer_count") >= ans_count) & (F.col("score") >= score))


DEFAULT_INDEX_CONDITIONS = ("accepted_answer_id IS NOT NULL", "score >= 1",
                            "answer_count >= 1", "snippet_count >= 1")


def filter_index_questions(df: DataFrame, conditions=DEFAULT_INDEX_CONDITIONS) -> DataFrame:
    """conjunction of configurable SQL predicates."""
    if not conditions:
        return df
    return df.filter(reduce(lambda a, b: a & b, [F.expr(c) for c in conditions]))


def select_noise_candidates(questions: DataFrame, words=NOISE_TITLE_WORDS,
                            min_words: int = 150) -> DataFrame:
    """title mentions a failure word, body has no </pre>, and the body has
    at least ``min_words`` space-separated words."""
    body = F.col("body")
    spaces = F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit("")))
    return questions.filter(_any_like(F.col("title"), words)
                            & ~body.contains("</pre>") & (spaces + 1 >= min_words))


def project_metadata(df: DataFrame, cols=("post_id", "score", "title", "etags",
                                          "snippet_count", "best")) -> DataFrame:
    """keep the configured metadata columns."""
    return df.select(*[c for c in cols if c in df.columns])


def filter_min_snippets(meta: DataFrame, n: int = 1) -> DataFrame:
    """metadata rows with at least ``n`` snippets."""
    return meta.filter(F.col("snippet_count") >= n)


def keep_clean(df: DataFrame, pred_col: str = "pred") -> DataFrame:
    """keep rows predicted clean (0), drop noise (1)."""
    return df.filter(F.col(pred_col) == 0)


def filter_low_quality(df: DataFrame, text_col: str = "text") -> DataFrame:
    """F8: keep short texts, and long ones only with quality >= 1.6."""
    return df.filter(T.keep_by_quality(F.col(text_col)))


def filter_tags(posts: DataFrame, tags, etags_col: str = "etags") -> DataFrame:
    """posts having at least one of ``tags``.  Unknown tags simply never
    match, and when none of the tags is known the result is empty."""
    wanted = F.array(*[F.lit(t) for t in tags]) if not isinstance(tags, Column) else tags
    return posts.filter(F.coalesce(F.arrays_overlap(F.col(etags_col), wanted), F.lit(False)))


def drop_short_vocab(tokens: DataFrame, min_freq: int = 5, token_col: str = "token") -> DataFrame:
    """(token, freq) of tokens occurring at least ``min_freq`` times."""
    return (tokens.groupBy(token_col).agg(F.count(F.lit(1)).alias("freq"))
            .filter(F.col("freq") >= min_freq))
