"""Software-entity extraction.

Token sequences are a long table (sent_id, pos, token).  Neighbour features
use lag/lead over a window partitioned by sentence (bounded by sentence
length); lookups (gazetteer, Brown paths) are left joins on the token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ortho
from ..functions.text import split_sentences
from ..plans.strategy import checked_broadcast, lookup

GAZETTEER_TYPES = ("api", "plat", "pl", "org", "stan", "fram")
BROWN_PREFIXES = tuple(range(2, 16, 2))


def sentence_tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc id, sent_no, pos, token): sentences split, tokens by whitespace."""
    s = docs.select(id_col, F.posexplode(split_sentences(text_col)).alias("sent_no", "sentence"))
    t = s.select(id_col, "sent_no",
                 F.posexplode(F.filter(F.split("sentence", r"[ \t\n\f\r]+"), lambda x: x != ""))
                 .alias("pos", "token"))
    return t


def gazetteer_join(tokens: DataFrame, gazetteer: DataFrame, token_col: str = "token") -> DataFrame:
    """Six T/F flags per token: lowercase, trailing '()' stripped, exact
    membership per gazetteer type.  The gazetteer (term, type) is lower-cased
    and pivoted to one row per term before the join (one row per token out)."""
    g = (gazetteer.select(F.lower("term").alias("_g"), "type").distinct()
         .groupBy("_g").agg(*[F.max(F.when(F.col("type") == ty, 1).otherwise(0)).alias(f"_{ty}")
                              for ty in GAZETTEER_TYPES]))
    # a gazetteer is a term list: broadcast behind a row check, so the token
    # stream is never shuffled by token (frequent tokens would skew)
    g = checked_broadcast(g)
    key = F.lower(F.regexp_replace(F.col(token_col), r"\(\)$", ""))
    j = tokens.withColumn("_k", key).join(g, F.col("_k") == F.col("_g"), "left")
    return j.select(*tokens.columns, *[F.when(F.col(f"_{ty}") == 1, "T").otherwise("F")
                                       .alias(f"is_{ty}") for ty in GAZETTEER_TYPES])


def brown_prefixes(path) -> dict:
    """Name -> prefix of a Brown path."""
    return {f"brown_p{p}": F.substring(path, 1, p) for p in BROWN_PREFIXES}


def brown_join(tokens: DataFrame, brown: DataFrame, token_col: str = "token") -> DataFrame:
    """Brown path of the token and its prefixes of length 2..14; empty
    strings when the token has no path."""
    j = lookup(tokens, brown.select(F.col("token").alias(token_col), F.col("path").alias("_p")), token_col)
    path = F.coalesce("_p", F.lit(""))
    return j.select(*tokens.columns, path.alias("brown"), *[x.alias(n) for n, x in brown_prefixes(path).items()])


ORTH_TAGS = ("w", "wl", "dot", "brac", "uscr", "init_cap", "ccase", "api_ptrn",
             "p1", "p2", "p3", "p4", "s1", "s2", "s3", "s4")


def context_features(tok: DataFrame, seq_keys: list[str], with_brown: bool = True,
                     ce_ks=()) -> DataFrame:
    """Feature strings per token from the template: orthographic and
    gazetteer features of the token, word bigrams (-1,0) (0,1), Brown path
    unigrams at -1/0/+1, bigrams and the (-1,+1) skip pair, Brown prefixes at
    -1/0/+1, optionally the compound-embedding features of ``ce_ks``
    (``compound_join`` columns), and __BOS__ / __EOS__ flags.  A feature that
    needs an absent neighbour is absent.

    Input: seq_keys + (pos, token, is_* flags, brown).  What a neighbour
    contributes follows from its token, path and clusters: the window moves these
    alone, and all features are a projection of three tokens after it."""
    brown = with_brown and "brown" in tok.columns
    flags = [f"is_{ty}" for ty in GAZETTEER_TYPES if f"is_{ty}" in tok.columns]
    moved = ["token", *(["brown"] if brown else []), *(f"ce{k}" for k in ce_ks)]
    w = Window.partitionBy(*seq_keys).orderBy("pos")
    o = tok.select(*seq_keys, "pos", *moved, *flags)
    o = o.withColumn("_p", F.lag(F.struct(*moved)).over(w)).withColumn("_x", F.lead(F.struct(*moved)).over(w))
    o = o.withColumn("_o", ortho.orthographic_features("token"))

    def at(name):
        """A column of the token before, the token itself and the token after."""
        return [F.col("_p")[name], F.col(name), F.col("_x")[name]]

    def orth(tag):
        before, _, after = at("token")
        return [ortho.orthographic_features(before)[tag], F.col("_o")[tag], ortho.orthographic_features(after)[tag]]

    feats = []
    for tag in ORTH_TAGS:
        feats.append(F.concat(F.lit(f"{tag}[0]="), F.col("_o")[tag]))
    for ty in GAZETTEER_TYPES:
        if f"is_{ty}" in tok.columns:
            feats.append(F.concat(F.lit(f"is_{ty}[0]="), F.col(f"is_{ty}")))

    def pair(name, col_a, col_b, oa, ob):
        return F.concat(F.lit(f"{name}[{oa}]|{name}[{ob}]="), col_a, F.lit("|"), col_b)

    for tag in ("w", "wl"):
        prev, cur, nxt = orth(tag)
        feats.append(pair(tag, prev, cur, -1, 0))
        feats.append(pair(tag, cur, nxt, 0, 1))
    if brown:
        bp, b, bn = at("brown")
        feats += [F.concat(F.lit("brown[-1]="), bp), F.concat(F.lit("brown[0]="), b),
                  F.concat(F.lit("brown[1]="), bn),
                  pair("brown", bp, b, -1, 0), pair("brown", b, bn, 0, 1), pair("brown", bp, bn, -1, 1)]
        for p in BROWN_PREFIXES:
            feats += [F.concat(F.lit(f"brown-p{p}[{i}]="), F.substring(c, 1, p)) for i, c in zip((-1, 0, 1), at("brown"))]
    for k in ce_ks:
        feats += _compound_of(f"ce{k}", *at(f"ce{k}"))
    feats += [F.when(F.col("_p").isNull(), F.lit("__BOS__")), F.when(F.col("_x").isNull(), F.lit("__EOS__"))]
    arr = F.filter(F.array(*feats), lambda x: x.isNotNull())
    return o.select(*seq_keys, "pos", "token", arr.alias("features"))


def compound_join(tokens: DataFrame, compound: DataFrame, ks, token_col: str = "token") -> DataFrame:
    """V15 lookup: token -> ce<k> cluster ids as strings, '' when absent.
    ``compound`` is (token, clusters map<int,int>) (see models.compound_embeddings);
    broadcast behind a row check."""
    c = checked_broadcast(compound.select(F.col("token").alias("_c"), F.col("clusters").alias("_m")))
    j = tokens.join(c, F.col(token_col) == F.col("_c"), "left")
    return j.select(*tokens.columns, *[F.coalesce(F.col("_m")[k].cast("string"), F.lit("")).alias(f"ce{k}")
                                       for k in ks])


def compound_features(tok: DataFrame, seq_keys: list[str], ks) -> DataFrame:
    """W2 (compound-embedding part): for every k, ce<k> at -1, 0, +1, the
    bigrams (-1,0) (0,1) and the (-1,+1) skip pair; absent neighbours give
    absent features.  Input: seq_keys + (pos, token, ce<k> columns)."""
    w = Window.partitionBy(*seq_keys).orderBy("pos")
    t = tok.withColumn("_c", F.struct(*[F.col(f"ce{k}").alias(f"ce{k}") for k in ks]))
    t = t.withColumn("_p", F.lag("_c").over(w)).withColumn("_x", F.lead("_c").over(w))
    feats = [f for k in ks for f in _compound_of(f"ce{k}", F.col("_p")[f"ce{k}"], F.col("_c")[f"ce{k}"], F.col("_x")[f"ce{k}"])]
    return t.select(*seq_keys, "pos", "token", F.filter(F.array(*feats), lambda v: v.isNotNull()).alias("features"))


def _compound_of(n: str, p, c, x) -> list:
    return [F.concat(F.lit(f"{n}[-1]="), p), F.concat(F.lit(f"{n}[0]="), c),
            F.concat(F.lit(f"{n}[1]="), x),
            F.concat(F.lit(f"{n}[-1]|{n}[0]="), p, F.lit("|"), c),
            F.concat(F.lit(f"{n}[0]|{n}[1]="), c, F.lit("|"), x),
            F.concat(F.lit(f"{n}[-1]|{n}[1]="), p, F.lit("|"), x)]


def gazetteer_tags(tok: DataFrame, seq_keys: list[str]) -> DataFrame:
    """Gazetteer-only tagging (V18 fallback): B-type on the first flagged
    token of a run of the same type, I-type after it, O elsewhere."""
    ty = None
    for g in GAZETTEER_TYPES:
        c = F.when(F.col(f"is_{g}") == "T", F.lit(g))
        ty = c if ty is None else F.coalesce(ty, c)
    w = Window.partitionBy(*seq_keys).orderBy("pos")
    t = tok.withColumn("_ty", ty)
    prev = F.lag("_ty").over(w)
    tag = (F.when(F.col("_ty").isNull(), "O")
           .when(prev.isNotNull() & (prev == F.col("_ty")), F.concat(F.lit("I-"), "_ty"))
           .otherwise(F.concat(F.lit("B-"), "_ty")))
    return t.withColumn("tag", tag).drop("_ty")


def merge_bio_spans(tagged: DataFrame, seq_keys: list[str], legacy_gap: bool = False) -> DataFrame:
    """BIO token tags -> (seq_keys, span, entity 'type##tokens').

    An I-x continues the current entity when the previous token is of type x
    (standard BIO; an O resets).  With ``legacy_gap`` an I-x continues the
    last entity of type x even across O tokens."""
    w = Window.partitionBy(*seq_keys).orderBy("pos")
    typ = F.when(F.col("tag") != "O", F.col("tag").substr(F.lit(3), F.length("tag")))
    t = tagged.withColumn("_t", typ)
    if legacy_gap:
        prev = F.last("_t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    else:
        prev = F.lag("_t").over(w)
    start = F.when(F.col("_t").isNull(), 0).when(
        F.col("tag").startswith("I-") & prev.isNotNull() & (prev == F.col("_t")), 0).otherwise(1)
    t = t.withColumn("_s", start)
    t = t.withColumn("span", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ents = t.filter(F.col("_t").isNotNull())
    g = ents.groupBy(*seq_keys, "span").agg(
        F.min_by("_t", "pos").alias("type"),
        F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_l"))
    return g.select(*seq_keys, "span",
                    F.concat("type", F.lit("##"),
                             F.array_join(F.transform("_l", lambda x: x["token"]), " ")).alias("entity"))


def clean_entities(entities) -> F.Column:
    """T26 (array form): drop 'Type##', lowercase, cut a trailing bracketed
    tail, drop "'s", distinct (first occurrence order)."""
    return F.array_distinct(F.transform(entities, clean_entity))


def entity_pipeline(questions: DataFrame, answers: DataFrame, gazetteer: DataFrame,
                    legacy_gap: bool = False) -> DataFrame:
    """Post parts (question, then answers; A3) -> sentences -> tokens ->
    gazetteer tags -> BIO spans -> cleaned distinct entities per post,
    left-joined to questions.

    Parts are processed separately (a sentence never spans two posts) and
    entities are de-duplicated per (post, cleaned entity) before the per-post
    list is built, so the list is bounded by the post's distinct entities."""
    from .relational import attach_enrichment, distinct_entities, merge_post_text
    parts = merge_post_text(questions, answers)
    tok = sentence_tokens(parts.withColumn("pid", F.struct("post_id", "ord")), "pid", "text")
    tok = tok.select(F.col("pid.post_id").alias("post_id"), F.col("pid.ord").alias("ord"),
                     "sent_no", "pos", "token")
    keys = ["post_id", "ord", "sent_no"]
    tagged = gazetteer_tags(gazetteer_join(tok, gazetteer), keys)
    spans = merge_bio_spans(tagged, keys, legacy_gap)
    cleaned = spans.select("post_id", F.struct("ord", "sent_no", "span").alias("ord"),
                           clean_entity(F.col("entity")).alias("entity"))
    return attach_enrichment(questions, entities=distinct_entities(cleaned))


def clean_entity(e) -> F.Column:
    """T26 (one entity): drop 'Type##', lowercase, cut a trailing bracketed
    tail, drop "'s"."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.element_at(F.split(e, "##"), -1)),
                                             r"[(\[]\S*$", ""), "'s", "")
