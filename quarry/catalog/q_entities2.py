"""Checked queries: cleaned / distinct entities and the entity pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from .. import oracle_text as S
from ..operators import entities as EN
from ..operators.relational import distinct_entities
from ..sources import qa_model as M
from . import register
from .q_entities import _sent_tok_sql, _spans, gazetteer_df

_GAZ_TYPES = EN.GAZETTEER_TYPES
_PREV = "lag(ty) OVER (PARTITION BY id, sent_no ORDER BY pos)"


def _span_body(tagged: str) -> str:
    return f"""
        SELECT id, sent_no, CAST(span AS BIGINT) AS span,
               arg_min(ty, pos) || '##' || string_agg(token, ' ' ORDER BY pos) AS entity
        FROM (SELECT *, sum(st) OVER (PARTITION BY id, sent_no ORDER BY pos
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span FROM (
              SELECT *, CASE WHEN ty IS NULL THEN 0 WHEN starts_with(tag, 'I-') AND {_PREV} IS NOT NULL
                        AND {_PREV} = ty THEN 0 ELSE 1 END AS st FROM {tagged}))
        WHERE ty IS NOT NULL GROUP BY id, sent_no, span"""


def _tagged_body(tok: str) -> str:
    ty = "coalesce(" + ", ".join(f"CASE WHEN g.g_{t} = 1 THEN '{t}' END" for t in _GAZ_TYPES) + ")"
    key = r"lower(regexp_replace(b.token, '\(\)$', ''))"
    return (f"SELECT *, CASE WHEN ty IS NULL THEN 'O' WHEN lag(ty) OVER w IS NOT NULL AND "
            f"lag(ty) OVER w = ty THEN 'I-' || ty ELSE 'B-' || ty END AS tag FROM ("
            f"SELECT b.*, {ty} AS ty FROM {tok} b LEFT JOIN gaz g ON g.g = {key}) "
            "WINDOW w AS (PARTITION BY id, sent_no ORDER BY pos)")


_CLEAN = ("list_transform(list(entity ORDER BY sent_no, span), lambda x: replace(regexp_replace("
          "lower(split_part(x, '##', 2)), " + S.q(r"[(\[]\S*$") + ", ''), " + S.q("'s") + ", ''))")

_PART_ID = "{'post_id': post_id, 'ord': ord}"

O.CTES.update({
    "bspans": (_span_body("btagged"), ("btagged",)),
    "pparts": ("""SELECT post_id, CAST(0 AS BIGINT) AS ord, body AS text FROM questions
                  UNION ALL SELECT parent_id, answer_id, body FROM answers""", ("questions", "answers")),
    "ptok": (f"SELECT * FROM {_sent_tok_sql('pparts', _PART_ID, 'text')}", ("pparts",)),
    "ptagged": (_tagged_body("ptok"), ("ptok", "gaz")),
    "pspans": (_span_body("ptagged"), ("ptagged",)),
})


@register("t26_clean_entities", O.with_ctes(
    f"SELECT id, array_to_string({S.ordered_distinct(_CLEAN)}, ',') AS entities FROM bspans GROUP BY id",
    "bspans"))
def t26(spark, sf):
    sp = _spans(spark, sf, False)
    g = sp.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sent_no", "span", "entity"))).alias("l"))
    return g.select("id", F.array_join(EN.clean_entities(F.transform("l", lambda x: x["entity"])), ",")
                    .alias("entities"))


@register("a4_distinct_entities", O.with_ctes(
    "SELECT id AS post_id, array_to_string(" + S.ordered_distinct("list(entity ORDER BY sent_no, span)")
    + ", ',') AS entities FROM bspans GROUP BY id", "bspans"))
def a4(spark, sf):
    sp = _spans(spark, sf, False)
    ents = sp.select(F.col("id").alias("post_id"), F.struct("sent_no", "span").alias("ord"), "entity")
    return distinct_entities(ents).select("post_id", F.array_join("entities", ",").alias("entities"))


_CLEAN1 = ("replace(regexp_replace(lower(split_part(entity, '##', 2)), " + S.q(r"[(\[]\S*$")
           + ", ''), " + S.q("'s") + ", '')")


@register("p8_entity_pipeline", O.with_ctes(
    "SELECT q.post_id, coalesce(e.entities, '') AS entities FROM questions q LEFT JOIN ("
    "SELECT post_id, array_to_string(list(entity ORDER BY o), ',') AS entities FROM ("
    "SELECT id.post_id AS post_id, " + _CLEAN1 + " AS entity, "
    "min({'ord': id.ord, 'sent_no': sent_no, 'span': span}) AS o FROM pspans GROUP BY ALL) "
    "GROUP BY post_id) e USING (post_id)", "questions", "pspans"))
def p8(spark, sf):
    q = M.questions(spark, sf)
    out = EN.entity_pipeline(q, M.answers(spark, sf), gazetteer_df(spark))
    return out.select("post_id", F.array_join("entities", ",").alias("entities"))


# W2 compound-embedding features over a derived cluster table (fixture):
# clusters for k = 5 and 10 from the token's md5; tokens whose md5 starts
# with 'f' have no entry (empty features).
_CE_KS = (5, 10)


def _compound_fixture(tokens):
    t = tokens.select("token").distinct()
    h = F.md5("token")
    v = F.conv(F.substring(h, 1, 4), 16, 10).cast("long")
    return t.filter(F.substring(h, 1, 1) != "f").select(
        "token", F.create_map(*[x for k in _CE_KS for x in (F.lit(k), (v % k).cast("int"))]).alias("clusters"))


def _ce_sql() -> str:
    cols = ", ".join(
        f"CASE WHEN substr(md5(token), 1, 1) <> 'f' THEN CAST(CAST(('0x' || substr(md5(token), 1, 4)) AS INTEGER) % {k} AS VARCHAR) ELSE '' END AS ce{k}"
        for k in _CE_KS)
    feats = []
    for k in _CE_KS:
        n = f"ce{k}"
        feats += [f"'{n}[-1]=' || lag({n}) OVER w", f"'{n}[0]=' || {n}", f"'{n}[1]=' || lead({n}) OVER w",
                  f"'{n}[-1]|{n}[0]=' || lag({n}) OVER w || '|' || {n}",
                  f"'{n}[0]|{n}[1]=' || {n} || '|' || lead({n}) OVER w",
                  f"'{n}[-1]|{n}[1]=' || lag({n}) OVER w || '|' || lead({n}) OVER w"]
    arr = "list_filter([" + ", ".join(feats) + "], lambda v: v IS NOT NULL)"
    return O.with_ctes(
        f"SELECT id, sent_no, pos, token, array_to_string({arr}, chr(9)) AS features "
        f"FROM (SELECT *, {cols} FROM btok) WINDOW w AS (PARTITION BY id, sent_no ORDER BY pos)", "btok")


@register("w2_compound_features", _ce_sql())
def w2_ce(spark, sf):
    from .q_entities import _btok
    t = _btok(spark, sf)
    f = EN.compound_join(t, _compound_fixture(t), _CE_KS)
    out = EN.compound_features(f, ["id", "sent_no"], _CE_KS)
    return out.select("id", "sent_no", "pos", "token", F.array_join("features", "\t").alias("features"))
