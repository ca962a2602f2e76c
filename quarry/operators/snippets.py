"""Code snippets per question.

One pass over the answers: code blocks are extracted per answer row
(native regex), invalid blocks (no code token) dropped, then one
``groupBy(parent)`` builds each question's ordered snippet list.  The list
of a question is bounded by that question's own answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import text as T



def answer_snippets(answers: DataFrame) -> DataFrame:
    """(answer_id, parent_id, score, code) for answers with >= 1 valid block."""
    blocks = C.extract_code_blocks("body")
    valid = F.filter(blocks, lambda b: F.size(C.code_tokens(b)) > 0)
    a = answers.select("answer_id", "parent_id", "score", valid.alias("code"))
    return a.filter(F.size("code") > 0)


def snippets_per_question(answers: DataFrame) -> DataFrame:
    """A2: (post_id, snippet_count, best) per question: the number of valid
    code blocks over its answers and the best answer's snippet (highest score,
    then lowest answer id) as struct<answer_id, score, code>.  Answers without
    code contribute nothing.  Both are declarative aggregates (sum, max_by)
    with map-side partial aggregation, so a question holding a third of all
    answers is pre-aggregated per task and never collected into one row.
    The complete ordered list is the long table ``question_snippets``."""
    s = answer_snippets(answers)
    order = F.struct(F.col("score"), (-F.col("answer_id")).alias("neg_id"))
    best = F.max_by(F.struct("answer_id", "score", "code"), order)
    g = s.groupBy("parent_id").agg(F.sum(F.size("code")).cast("int").alias("snippet_count"),
                                   best.alias("best"))
    return g.select(F.col("parent_id").alias("post_id"), "snippet_count", "best")


def question_snippets(answers: DataFrame) -> DataFrame:
    """A2 (long form): (post_id, answer_id, score, code) of every answer with
    code; list order = score desc, answer_id asc (sort on read)."""
    s = answer_snippets(answers)
    return s.select(F.col("parent_id").alias("post_id"), "answer_id", "score", "code")


def best_answer_snippet(meta: DataFrame) -> DataFrame:
    """The top answer's snippet text (blocks joined by a blank line), its
    link and score; null-safe when a question has no snippet."""
    b = F.col("best")
    return meta.select(
        "post_id",
        F.array_join(b["code"], "\n\n").alias("best_snippet"),
        T.answer_link(b["answer_id"]).alias("answer_link"),
        b["score"].alias("answer_score"))


API_KINDS = ("IM", "OC", "MC")


def api_token_index(answers: DataFrame, keep=API_KINDS) -> DataFrame:
    """(answer_id, post_id, kind, token, n): the API tokens of every
    answer's code with their number, the table that a corpus build writes
    (``plans.corpus.build_corpus_sides``) and later stages read."""
    blocks = C.extract_code_blocks("body")
    toks = F.flatten(F.transform(blocks, lambda b: C.code_tokens(b, keep)))
    each = answers.select("answer_id", F.col("parent_id").alias("post_id"), F.explode(toks).alias("t"))
    return each.groupBy("answer_id", "post_id", F.col("t.kind").alias("kind"), F.col("t.token").alias("token")) \
        .agg(F.count(F.lit(1)).alias("n"))


def api_token_counts(answers: DataFrame, keep=API_KINDS) -> DataFrame:
    """(token, freq) of API tokens over all code of all answers."""
    return index_token_counts(api_token_index(answers, keep))


def index_token_counts(index: DataFrame) -> DataFrame:
    """(token, freq) out of a written API-token index."""
    return index.groupBy("token").agg(F.sum("n").alias("freq"))


def snippet_pipeline(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions enriched with snippet_count and snippets (J4 defaults)."""
    from .relational import answers_of, attach_enrichment
    return attach_enrichment(questions, snippets=snippets_per_question(answers_of(answers, questions)))
