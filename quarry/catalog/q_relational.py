"""Checked queries: filters, semi-joins, enrichment, metadata, snippets, code."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from .. import oracle_text as S
from ..functions import code as C
from ..functions import text as T
from ..operators import filters as FL
from ..operators import relational as R
from ..operators import snippets as SN
from ..sources import qa_model as M
from . import register

TOPIC_INCLUDE, TOPIC_EXCLUDE = ("en", "src1"), ("src10",)

O.CTES.update({
    "topic": ("""SELECT * FROM questions WHERE (tags ILIKE '%en%' OR tags ILIKE '%src1%')
                 AND NOT tags ILIKE '%src10%'""", ("questions",)),
    "answer_code": (f"""
        SELECT answer_id, parent_id, score,
               list_filter({S.extract_code_blocks('body')}, lambda b: len({S.code_tokens('b')}) > 0) AS code
        FROM answers""", ("answers",)),
    "snips": ("""
        SELECT s.post_id, s.snippet_count, b.best FROM
          (SELECT parent_id AS post_id, CAST(sum(len(code)) AS INTEGER) AS snippet_count
           FROM answer_code WHERE len(code) > 0 GROUP BY parent_id) s
        JOIN (SELECT parent_id AS post_id, {'answer_id': answer_id, 'score': score, 'code': code} AS best
              FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY score DESC, answer_id) AS rn
                    FROM answer_code WHERE len(code) > 0) WHERE rn = 1) b USING (post_id)""",
              ("answer_code",)),
    "enriched": ("""
        SELECT q.*, coalesce(s.snippet_count, 0) AS snippet_count, s.best
        FROM questions q LEFT JOIN snips s USING (post_id)""", ("questions", "snips")),
    "meta": (f"""
        SELECT post_id, score, title,
               list_sort(list_distinct(list_filter({S.parse_tags('tags')}, lambda x: x <> ''))) AS etags,
               snippet_count, best
        FROM enriched""", ("enriched",)),
})


def _topic(spark, sf):
    return FL.select_topic_questions(M.questions(spark, sf), TOPIC_INCLUDE, TOPIC_EXCLUDE)


def _enriched(spark, sf):
    q = M.questions(spark, sf)
    return R.attach_enrichment(q, snippets=SN.snippets_per_question(M.answers(spark, sf)))


def _meta(spark, sf):
    return R.build_metadata(_enriched(spark, sf))


# ------------------------------------------------------------------ filters
@register("f1_select_topic_questions", O.with_ctes("SELECT post_id, tags FROM topic", "topic"))
def f1(spark, sf):
    return _topic(spark, sf).select("post_id", "tags")


@register("f2_filter_questions", O.with_ctes(
    "SELECT post_id FROM questions WHERE answer_count >= 1 AND score >= -3", "questions"))
def f2(spark, sf):
    return FL.filter_questions(M.questions(spark, sf), 1, -3).select("post_id")


@register("f3_filter_index_questions", O.with_ctes(
    "SELECT post_id FROM enriched WHERE accepted_answer_id IS NOT NULL AND score >= 1 "
    "AND answer_count >= 1 AND snippet_count >= 1", "enriched"))
def f3(spark, sf):
    return FL.filter_index_questions(_enriched(spark, sf)).select("post_id")


_NOISE_WORDS = ("error", "fail", "the", "debug", "warning")


@register("f4_select_noise_candidates", O.with_ctes(
    "SELECT post_id FROM questions WHERE ("
    + " OR ".join(f"title ILIKE '%{w}%'" for w in _NOISE_WORDS)
    + ") AND NOT contains(body, '</pre>') AND "
    "(length(body) - length(replace(body, ' ', ''))) + 1 >= 150", "questions"))
def f4(spark, sf):
    return FL.select_noise_candidates(M.questions(spark, sf), _NOISE_WORDS, 150).select("post_id")


@register("f5_project_metadata", O.with_ctes(
    "SELECT post_id, score, title, snippet_count FROM meta", "meta"))
def f5(spark, sf):
    return FL.project_metadata(_meta(spark, sf), ("post_id", "score", "title", "snippet_count"))


@register("f6_filter_min_snippets", O.with_ctes(
    "SELECT post_id, snippet_count FROM meta WHERE snippet_count >= 2", "meta"))
def f6(spark, sf):
    return FL.filter_min_snippets(_meta(spark, sf), 2).select("post_id", "snippet_count")


@register("f7_keep_clean",
          "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE 1 - l.quality = 0")
def f7(spark, sf):
    lab = M.table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("pred"))
    return FL.keep_clean(M.table(spark, sf, "documents").join(lab, "doc_id")).select("doc_id")


@register("f9_filter_tags", O.with_ctes(
    "SELECT post_id FROM meta WHERE list_has_any(etags, ['en', 'src3', 'no-such-tag'])", "meta"))
def f9(spark, sf):
    return FL.filter_tags(_meta(spark, sf), ["en", "src3", "no-such-tag"]).select("post_id")


@register("f10_drop_short_vocab",
          "SELECT token, count(*) AS freq FROM (SELECT unnest(string_split(text, ' ')) AS token "
          "FROM documents) GROUP BY token HAVING count(*) >= 5")
def f10(spark, sf):
    d = M.table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("token"))
    return FL.drop_short_vocab(d, 5)


# ------------------------------------------------------------------ joins
@register("j1_answers_of", O.with_ctes(
    "SELECT answer_id, parent_id FROM answers WHERE parent_id IN (SELECT post_id FROM topic)",
    "answers", "topic"))
def j1(spark, sf):
    return R.answers_of(M.answers(spark, sf), _topic(spark, sf)).select("answer_id", "parent_id")


@register("j2_comments_of", O.with_ctes(
    "SELECT comment_id, post_id FROM comments WHERE post_id IN (SELECT post_id FROM topic) "
    "OR post_id IN (SELECT answer_id FROM answers WHERE parent_id IN (SELECT post_id FROM topic))",
    "comments", "answers", "topic"))
def j2(spark, sf):
    t = _topic(spark, sf)
    a = R.answers_of(M.answers(spark, sf), t)
    return R.comments_of(M.comments(spark, sf), t, a).select("comment_id", "post_id")


@register("j3_links_within", O.with_ctes(
    "SELECT src_id, dst_id, link_type FROM postlinks WHERE src_id IN (SELECT post_id FROM topic) "
    "AND dst_id IN (SELECT post_id FROM topic)", "postlinks", "topic"))
def j3(spark, sf):
    return R.links_within(M.postlinks(spark, sf), _topic(spark, sf))


@register("j4_attach_enrichment", O.with_ctes(
    "SELECT post_id, snippet_count, best.answer_id AS best_answer FROM enriched", "enriched"))
def j4(spark, sf):
    e = _enriched(spark, sf)
    return e.select("post_id", "snippet_count", F.col("best.answer_id").alias("best_answer"))


@register("j5_final_frames", O.with_ctes(
    f"SELECT post_id, title, score, length({S.html_to_text('body')}) AS n_chars FROM questions "
    f"WHERE {S.keep_by_quality(S.html_to_text('body'))}", "questions"))
def j5(spark, sf):
    q = M.questions(spark, sf)
    clean = FL.filter_low_quality(q.select("post_id", T.html_to_text("body").alias("text")), "text")
    out = R.final_frames(clean, q.select("post_id", "title", "score"), "post_id")
    return out.select("post_id", "title", "score", F.length("text").cast("bigint").alias("n_chars"))


@register("j6_index_dataset", O.with_ctes(
    "SELECT post_id, title FROM questions WHERE post_id IN (SELECT post_id FROM enriched WHERE "
    "accepted_answer_id IS NOT NULL AND score >= 1 AND answer_count >= 1 AND snippet_count >= 1)",
    "questions", "enriched"))
def j6(spark, sf):
    ids = FL.filter_index_questions(_enriched(spark, sf))
    return R.index_dataset(M.questions(spark, sf), ids).select("post_id", "title")


@register("j8_linked_pairs", O.with_ctes(
    "SELECT DISTINCT src_id, dst_id FROM postlinks WHERE src_id IN (SELECT post_id FROM topic) "
    "AND dst_id IN (SELECT post_id FROM topic)", "postlinks", "topic"))
def j8(spark, sf):
    return R.linked_pairs(M.postlinks(spark, sf), _topic(spark, sf))


# ------------------------------------------------------------------ aggregations
@register("a1_token_frequencies",
          "SELECT token, count(*) AS freq FROM (SELECT unnest(string_split(text, ' ')) AS token "
          "FROM documents) WHERE token <> '' GROUP BY token")
def a1(spark, sf):
    return R.token_frequencies(M.table(spark, sf, "documents"))


@register("a2_snippets_per_question", O.with_ctes(
    "SELECT post_id, snippet_count, best.answer_id AS best_answer, best.score AS best_score, "
    "array_to_string(best.code, '\n--\n') AS best_code FROM snips", "snips"))
def a2(spark, sf):
    s = SN.snippets_per_question(M.answers(spark, sf))
    return s.select("post_id", "snippet_count", F.col("best.answer_id").alias("best_answer"),
                    F.col("best.score").alias("best_score"),
                    F.array_join("best.code", "\n--\n").alias("best_code"))


@register("a2_question_snippets", O.with_ctes(
    "SELECT parent_id AS post_id, answer_id, score, CAST(len(code) AS INTEGER) AS n_blocks "
    "FROM answer_code WHERE len(code) > 0", "answer_code"))
def a2_long(spark, sf):
    s = SN.question_snippets(M.answers(spark, sf))
    return s.select("post_id", "answer_id", "score", F.size("code").alias("n_blocks"))


@register("a3_merge_post_text", O.with_ctes(
    "SELECT post_id, CAST(0 AS BIGINT) AS ord, md5(body) AS text_md5 FROM questions "
    "UNION ALL SELECT parent_id, answer_id, md5(body) FROM answers", "questions", "answers"))
def a3(spark, sf):
    m = R.merge_post_text(M.questions(spark, sf), M.answers(spark, sf))
    return m.select("post_id", "ord", F.md5("text").alias("text_md5"))


@register("a5_build_metadata", O.with_ctes(
    "SELECT post_id, score, title, array_to_string(etags, ',') AS etags, snippet_count FROM meta",
    "meta"))
def a5(spark, sf):
    return _meta(spark, sf).select("post_id", "score", "title",
                                   F.array_join("etags", ",").alias("etags"), "snippet_count")


@register("a6_build_etag_index", O.with_ctes(
    "SELECT DISTINCT unnest(etags) AS etag, post_id FROM meta", "meta"))
def a6(spark, sf):
    return R.build_etag_index(_meta(spark, sf))


@register("a6_etag_counts", O.with_ctes(
    "SELECT etag, count(*) AS n_posts FROM (SELECT DISTINCT unnest(etags) AS etag, post_id FROM meta) "
    "GROUP BY etag", "meta"))
def a6_counts(spark, sf):
    return R.etag_counts(R.build_etag_index(_meta(spark, sf)))


@register("a11_postlink_frequencies", O.with_ctes(
    "SELECT post_id, count(*) AS links FROM (SELECT src_id AS post_id FROM (SELECT DISTINCT src_id, "
    "dst_id FROM postlinks) UNION ALL SELECT dst_id FROM (SELECT DISTINCT src_id, dst_id FROM "
    "postlinks)) GROUP BY post_id HAVING count(*) >= 2", "postlinks"))
def a11(spark, sf):
    return R.postlink_frequencies(M.postlinks(spark, sf), 2)


@register("w5_top_by_score", O.with_ctes(
    "SELECT post_id, score FROM questions ORDER BY score DESC, post_id LIMIT 100", "questions"))
def w5(spark, sf):
    return R.top_by_score(M.questions(spark, sf).select("post_id", "score"), 100)


@register("w9_symmetric_pairs", O.with_ctes(
    "SELECT src_id, dst_id FROM postlinks UNION SELECT dst_id, src_id FROM postlinks", "postlinks"))
def w9(spark, sf):
    return R.symmetric_pairs(M.postlinks(spark, sf))


# ------------------------------------------------------------------ code / snippets
def _tokstr(arr: str) -> str:
    return f"array_to_string(list_transform({arr}, lambda t: t.kind || ':' || t.token), ' | ')"


@register("t3_extract_code_blocks", O.with_ctes(
    f"SELECT answer_id, CAST(len({S.extract_code_blocks('body')}) AS INTEGER) AS n_blocks, "
    f"array_to_string({S.extract_code_blocks('body')}, '\n--\n') AS blocks FROM answers", "answers"))
def t3(spark, sf):
    b = C.extract_code_blocks("body")
    return M.answers(spark, sf).select("answer_id", F.size(b).alias("n_blocks"),
                                       F.array_join(b, "\n--\n").alias("blocks"))


@register("t17_code_tokens", O.with_ctes(
    f"SELECT answer_id, {_tokstr(S.code_tokens('body'))} AS tokens FROM answers", "answers"))
def t17(spark, sf):
    t = C.code_tokens(F.col("body"))
    return M.answers(spark, sf).select("answer_id", F.array_join(
        F.transform(t, lambda x: F.concat(x["kind"], F.lit(":"), x["token"])), " | ").alias("tokens"))


@register("t17_code_tokens_distinct", O.with_ctes(
    f"SELECT answer_id, array_to_string({S.code_token_strings('body', ('IM', 'OC', 'MC'))}, ' ') "
    "AS tokens FROM answers", "answers"))
def t17d(spark, sf):
    t = C.code_token_strings(F.col("body"), ("IM", "OC", "MC"), distinct=True)
    return M.answers(spark, sf).select("answer_id", F.array_join(t, " ").alias("tokens"))


@register("t18_lex_code", O.with_ctes(
    f"SELECT answer_id, array_to_string(flatten(list_transform({S.extract_code_blocks('body')}, "
    f"lambda b: {S.lex_code('b')})), ' ') AS lexemes FROM answers", "answers"))
def t18(spark, sf):
    lx = F.flatten(F.transform(C.extract_code_blocks("body"), C.lex_code))
    return M.answers(spark, sf).select("answer_id", F.array_join(lx, " ").alias("lexemes"))


@register("a13_api_token_counts", O.with_ctes(
    "SELECT token, count(*) AS freq FROM (SELECT unnest(flatten(list_transform("
    f"{S.extract_code_blocks('body')}, lambda b: {S.code_token_strings('b', ('IM', 'OC', 'MC'), False)})))"
    " AS token FROM answers) GROUP BY token", "answers"))
def a13(spark, sf):
    return SN.api_token_counts(M.answers(spark, sf))


@register("w4_best_answer_snippet", O.with_ctes(
    "SELECT post_id, array_to_string(best.code, '\n\n') AS best_snippet, "
    "'https://stackoverflow.com/a/' || CAST(best.answer_id AS VARCHAR) AS answer_link, "
    "best.score AS answer_score FROM meta", "meta"))
def w4(spark, sf):
    return SN.best_answer_snippet(_meta(spark, sf))


@register("w8_dedupe_sequence",
          f"SELECT doc_id, array_to_string({S.ordered_distinct('string_split(text, chr(32))')}, ' ') "
          "AS tokens FROM documents")
def w8(spark, sf):
    return M.table(spark, sf, "documents").select(
        "doc_id", F.array_join(C.dedupe_sequence(F.split("text", " ")), " ").alias("tokens"))


def _t4_sql() -> str:
    code = "CASE WHEN instr(p, '</pre>') > 0 THEN split_part(p, '</pre>', 1) ELSE p END"
    toks = S.code_token_strings(S.unescape(S.rr(code, "<[^>]*>", " ")))
    piece = (f"CASE WHEN i = 1 THEN p ELSE concat_ws(' ', array_to_string({toks}, ' '), "
             "CASE WHEN instr(p, '</pre>') > 0 THEN substr(p, instr(p, '</pre>') + 6) ELSE '' END) END")
    return ("SELECT answer_id, array_to_string(list_transform(string_split_regex(body, "
            f"'(?i)<pre[^>]*>'), lambda p, i: {piece}), ' ') AS body FROM answers")


@register("t4_replace_code_with_tokens", O.with_ctes(_t4_sql(), "answers"))
def t4(spark, sf):
    return M.answers(spark, sf).select("answer_id", C.replace_code_with_tokens("body").alias("body"))
