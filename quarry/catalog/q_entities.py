"""Checked queries: token features, gazetteer/Brown lookups, BIO spans, entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from .. import oracle_text as S
from ..functions import ortho
from ..operators import entities as EN
from ..sources import qa_model as M
from . import register

# Fixture gazetteer (fixed values): frequent fixture tokens per entity type,
# plus one multi-word entry that can never equal a single token.
GAZETTEER = [("the", "api"), ("and", "api"), ("of", "plat"), ("is", "plat"), ("la", "pl"),
             ("le", "pl"), ("der", "org"), ("die", "org"), ("und", "stan"), ("de", "stan"),
             ("el", "fram"), ("en", "fram"), ("Apache Ant", "fram")]


def gazetteer_df(spark):
    return spark.createDataFrame(GAZETTEER, "term string, type string")


def brown_df(tokens):
    """Fixture Brown paths: a bit string from the token's md5 for tokens whose
    md5 starts with a digit (others have no path)."""
    t = tokens.select("token").distinct()
    h = F.md5("token")
    return t.filter(F.substring(h, 1, 1) < "a").select(
        "token", F.bin(F.conv(F.substring(h, 1, 4), 16, 10).cast("long")).alias("path"))


_GAZ_VALUES = ", ".join(f"({S.q(a)}, {S.q(b)})" for a, b in GAZETTEER)
_FLAGS = ", ".join(f"max(CASE WHEN type = {S.q(t)} THEN 1 ELSE 0 END) AS g_{t}"
                   for t in EN.GAZETTEER_TYPES)


def _sent_tok_sql(src: str, id_expr: str, text: str) -> str:
    return f"""(SELECT id, sent_no, unnest(a) AS token, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos FROM (
        SELECT id, sent_no, list_filter(string_split_regex(sentence, '[ \\t\\n\\f\\r]+'),
               lambda x: x <> '') AS a FROM (
          SELECT id, unnest(arr) AS sentence, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS sent_no FROM (
            SELECT {id_expr} AS id, {S.split_sentences(text)} AS arr FROM {src}))))"""


O.CTES.update({
    "gaz": (f"SELECT lower(term) AS g, {_FLAGS} FROM (VALUES {_GAZ_VALUES}) v(term, type) "
            "GROUP BY lower(term)", ()),
    "dtokens": ("SELECT DISTINCT unnest(string_split_regex(text, '[ \\t\\n\\f\\r]+')) AS token "
                "FROM documents", ()),
    "btok": (f"SELECT * FROM {_sent_tok_sql('documents', 'doc_id', 'text')}", ()),
    "btok_flags": ("SELECT b.*, " + ", ".join(
        f"CASE WHEN g.g_{t} = 1 THEN 'T' ELSE 'F' END AS is_{t}" for t in EN.GAZETTEER_TYPES)
        + " FROM btok b LEFT JOIN gaz g ON g.g = lower(regexp_replace(b.token, '\\(\\)$', ''))",
        ("btok", "gaz")),
    "btagged": ("SELECT *, CASE WHEN ty IS NULL THEN 'O' WHEN lag(ty) OVER w IS NOT NULL AND "
                "lag(ty) OVER w = ty THEN 'I-' || ty ELSE 'B-' || ty END AS tag FROM (SELECT *, "
                "coalesce(" + ", ".join(f"CASE WHEN is_{t} = 'T' THEN '{t}' END" for t in EN.GAZETTEER_TYPES)
                + ") AS ty FROM btok_flags) WINDOW w AS (PARTITION BY id, sent_no ORDER BY pos)",
                ("btok_flags",)),
})


def _gaz_flags_sql(tok: str) -> str:
    return ", ".join(f"CASE WHEN g.g_{t} = 1 THEN 'T' ELSE 'F' END AS is_{t}" for t in EN.GAZETTEER_TYPES)


def _dtokens(spark, sf):
    d = M.table(spark, sf, "documents")
    return d.select(F.explode(F.split("text", r"[ \t\n\f\r]+")).alias("token")).distinct()


def _btok(spark, sf):
    d = M.table(spark, sf, "documents")
    return EN.sentence_tokens(d, "doc_id", "text").withColumnRenamed("doc_id", "id")


@register("t27_token_type", O.with_ctes(
    f"SELECT token, {S.token_type('token')} AS type FROM dtokens", "dtokens"))
def t27(spark, sf):
    return _dtokens(spark, sf).select("token", ortho.token_type("token").alias("type"))


@register("t28_token_shape", O.with_ctes(
    f"SELECT token, {S.token_shape('token')} AS shape FROM dtokens", "dtokens"))
def t28(spark, sf):
    return _dtokens(spark, sf).select("token", ortho.token_shape("token").alias("shape"))


_ORTH = S.ortho_cols("token")


@register("t29_orthographic_features", O.with_ctes(
    "SELECT " + ", ".join(f"{v} AS {k}" for k, v in _ORTH.items()) + " FROM dtokens", "dtokens"))
def t29(spark, sf):
    o = _dtokens(spark, sf).select(ortho.orthographic_features("token").alias("o"))
    return o.select(*[F.col("o")[k].alias(k) for k in _ORTH])


@register("j13_gazetteer_join", O.with_ctes(
    f"SELECT d.token, {_gaz_flags_sql('d.token')} FROM dtokens d LEFT JOIN gaz g "
    "ON g.g = lower(regexp_replace(d.token, '\\(\\)$', ''))", "dtokens", "gaz"))
def j13(spark, sf):
    return EN.gazetteer_join(_dtokens(spark, sf), gazetteer_df(spark))


_BROWN_SQL = ("SELECT DISTINCT token, bin(CAST(('0x' || substr(md5(token), 1, 4)) AS INTEGER)) AS path "
              "FROM btok WHERE substr(md5(token), 1, 1) < 'a'")


@register("j14_brown_join", O.with_ctes(
    "SELECT t.id, t.sent_no, t.pos, t.token, coalesce(b.path, '') AS brown, "
    + ", ".join(f"left(coalesce(b.path, ''), {p}) AS brown_p{p}" for p in EN.BROWN_PREFIXES)
    + f" FROM btok t LEFT JOIN ({_BROWN_SQL}) b USING (token)", "btok"))
def j14(spark, sf):
    t = _btok(spark, sf)
    return EN.brown_join(t, brown_df(t))


def _w2_sql() -> str:
    feats = [f"'{k}[0]=' || {v}" for k, v in S.ortho_cols("t.token").items() if k in EN.ORTH_TAGS]
    feats += [f"'is_{g}[0]=' || is_{g}" for g in EN.GAZETTEER_TYPES]
    for tag, ex in (("w", "t.token"), ("wl", "lower(t.token)")):
        feats += [f"'{tag}[-1]|{tag}[0]=' || lag({ex}) OVER w || '|' || {ex}",
                  f"'{tag}[0]|{tag}[1]=' || {ex} || '|' || lead({ex}) OVER w"]
    feats += ["'brown[-1]=' || lag(brown) OVER w", "'brown[0]=' || brown", "'brown[1]=' || lead(brown) OVER w",
              "'brown[-1]|brown[0]=' || lag(brown) OVER w || '|' || brown",
              "'brown[0]|brown[1]=' || brown || '|' || lead(brown) OVER w",
              "'brown[-1]|brown[1]=' || lag(brown) OVER w || '|' || lead(brown) OVER w"]
    for p in EN.BROWN_PREFIXES:
        feats += [f"'brown-p{p}[-1]=' || lag(brown_p{p}) OVER w", f"'brown-p{p}[0]=' || brown_p{p}",
                  f"'brown-p{p}[1]=' || lead(brown_p{p}) OVER w"]
    feats += ["CASE WHEN lag(1) OVER w IS NULL THEN '__BOS__' END",
              "CASE WHEN lead(1) OVER w IS NULL THEN '__EOS__' END"]
    arr = "list_filter([" + ", ".join(feats) + "], lambda x: x IS NOT NULL)"
    return O.with_ctes(
        f"SELECT t.id, t.sent_no, t.pos, t.token, array_to_string({arr}, chr(9)) AS features "
        "FROM (SELECT f.*, coalesce(b.path, '') AS brown, "
        + ", ".join(f"left(coalesce(b.path, ''), {p}) AS brown_p{p}" for p in EN.BROWN_PREFIXES)
        + f" FROM btok_flags f LEFT JOIN ({_BROWN_SQL}) b USING (token)) t "
        "WINDOW w AS (PARTITION BY t.id, t.sent_no ORDER BY t.pos)", "btok_flags", "btok")


@register("w2_context_features", _w2_sql())
def w2(spark, sf):
    t = _btok(spark, sf)
    f = EN.brown_join(EN.gazetteer_join(t, gazetteer_df(spark)), brown_df(t))
    out = EN.context_features(f, ["id", "sent_no"])
    return out.select("id", "sent_no", "pos", "token", F.array_join("features", "\t").alias("features"))


def _spans_sql(legacy: bool) -> str:
    prev = ("last_value(ty IGNORE NULLS) OVER (PARTITION BY id, sent_no ORDER BY pos "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)") if legacy else \
        "lag(ty) OVER (PARTITION BY id, sent_no ORDER BY pos)"
    return O.with_ctes(f"""
        SELECT id, sent_no, CAST(span AS BIGINT) AS span,
               arg_min(ty, pos) || '##' || string_agg(token, ' ' ORDER BY pos) AS entity
        FROM (SELECT *, sum(st) OVER (PARTITION BY id, sent_no ORDER BY pos
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span FROM (
              SELECT *, CASE WHEN ty IS NULL THEN 0 WHEN starts_with(tag, 'I-') AND {prev} IS NOT NULL
                        AND {prev} = ty THEN 0 ELSE 1 END AS st FROM btagged))
        WHERE ty IS NOT NULL GROUP BY id, sent_no, span""", "btagged")


def _spans(spark, sf, legacy):
    t = _btok(spark, sf)
    tagged = EN.gazetteer_tags(EN.gazetteer_join(t, gazetteer_df(spark)), ["id", "sent_no"])
    return EN.merge_bio_spans(tagged, ["id", "sent_no"], legacy_gap=legacy)


@register("w3_merge_bio_spans", _spans_sql(False))
def w3(spark, sf):
    return _spans(spark, sf, False)


@register("w3_merge_bio_spans_legacy", _spans_sql(True))
def w3l(spark, sf):
    return _spans(spark, sf, True)


