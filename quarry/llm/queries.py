"""The checked queries of the training-data operators: ``QUERIES`` maps a name
to (spark, sf_dir) -> DataFrame, ``SQL`` to its DuckDB equivalent where SQL can
express the result.  Queries use production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontam, lm, neardup, negatives, packing, quality, repeats, secrets, sharding, topk, urls, variants,
               warc)
from .common import fold, table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


@query("op3_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op4_warc_archive", """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (
  SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM m""")
def warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.index(warc.read_archives(manifest, with_data=False))


URL_RULES = [urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"),
             urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/"),
             urls.Rule("block", "net", "/fr/")]


@query("op6_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op8_sequence_packing")
def sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as pt
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer=str(pt.path("byte_bpe_50k.json")),
                        ranks=str(pt.path("byte_bpe_50k.tiktoken")), pattern=pt.PATTERN)


@query("op9_topk_search", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, i.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.c, i.c), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v i ON q.vec_id <> i.vec_id AND len(q.c) = len(i.c)
  WHERE q.vec_id % 100 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk_search(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(100)) == 0, k=10)


@query("op1_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, table(spark, sf_dir, "labels"), learn=fold(F.col("doc_id"), 5) != 0)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query("op10_repeated_units", """
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^.!?\\n]+|[.!?\\n]+') AS a
  FROM documents WHERE text <> ''),
g AS (
  SELECT doc_id, unnest(a) AS piece, generate_subscripts(a, 1) AS g FROM t),
go AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY g) - length(piece) AS base FROM g),
p AS (
  SELECT doc_id, g, base, unnest(x) AS w, generate_subscripts(x, 1) AS i
  FROM (SELECT *, regexp_extract_all(piece, '[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS x
        FROM go WHERE regexp_matches(piece, '^[^.!?\\n]'))),
po AS (
  SELECT *, base + sum(length(w)) OVER (PARTITION BY doc_id, g ORDER BY i) AS "end" FROM p),
w AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS words, lag(w) OVER (PARTITION BY doc_id, g ORDER BY i) AS prev
  FROM po WHERE regexp_matches(w, '^[^\\x20\\x09-\\x0D]')),
b AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR words > 16 AND substr(md5(prev), 1, 1) IN ('0', '1') THEN 1 ELSE 0 END)
            OVER (PARTITION BY doc_id ORDER BY g, i) - 1 AS unit_no
  FROM w),
u AS (
  SELECT doc_id, unit_no, min("end" - length(w)) AS start, max("end") AS "end", count(*) AS n_words,
         string_agg(w, ' ' ORDER BY g, i) AS norm
  FROM b GROUP BY doc_id, unit_no),
c AS (
  SELECT *, sum(n_words) OVER (PARTITION BY doc_id ORDER BY unit_no) AS upto FROM u),
j AS (
  SELECT f.doc_id, f.unit_no AS first_no, l.unit_no AS last_no
  FROM (SELECT *, upto - n_words + 20 AS wanted FROM c) f
  ASOF JOIN c l ON f.doc_id = l.doc_id AND f.wanted <= l.upto),
d AS (
  SELECT j.doc_id, first_no, min(start) AS start, max("end") AS "end", sum(n_words) AS n_words,
         md5(string_agg(norm, ' ' ORDER BY unit_no)) AS digest
  FROM j JOIN u ON u.doc_id = j.doc_id AND unit_no BETWEEN first_no AND last_no
  GROUP BY j.doc_id, first_no),
k AS (
  SELECT *, first_value(doc_id) OVER o AS kept_doc_id, first_value(first_no) OVER o AS kept_unit_no,
         first_value("end") OVER o AS kept_end
  FROM d WINDOW o AS (PARTITION BY digest ORDER BY doc_id, first_no))
SELECT doc_id, first_no::INTEGER AS unit_no, start::BIGINT AS start, "end"::BIGINT AS "end", n_words::INTEGER AS n_words,
       digest, kept_doc_id, kept_unit_no::INTEGER AS kept_unit_no
FROM k WHERE doc_id <> kept_doc_id OR first_no <> kept_unit_no AND start >= kept_end""")
def repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_units(table(spark, sf_dir, "documents"))


@query("op10_later_occurrences", """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text <> ''),
o AS (
  SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS start,
         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm
  FROM l),
u AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS unit_no,
         start::BIGINT AS start, (start + length(line))::BIGINT AS "end",
         len(string_split(norm, ' '))::INTEGER AS n_words, md5(norm) AS digest
  FROM o WHERE norm <> ''),
f AS (
  SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(unit_no) OVER w AS kept_unit_no
  FROM u WINDOW w AS (PARTITION BY digest ORDER BY doc_id, unit_no))
SELECT doc_id, unit_no, start, "end", n_words, digest, kept_doc_id, kept_unit_no
FROM f WHERE doc_id <> kept_doc_id OR unit_no <> kept_unit_no""")
def later_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later occurrence of a line, however short."""
    return repeats.repeated_units(table(spark, sf_dir, "documents"), unit="line", min_words=1)


@query("op7_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), every_item=True)


@query("op2_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 7) == 2
    scored = lm.train_and_score(docs, ~held)
    return scored.withColumn("held_out", held).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


@query("op5_minhash_near_duplicates")
def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op11_sharding")
def hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.uniform(40))


@query("op12_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, i.vec_id AS vec_id, a.label = i.label AS same,
         list_sum(list_transform(list_zip(a.c, i.c), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v i ON a.vec_id <> i.vec_id AND len(a.c) = len(i.c)
  WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return negatives.hard_negatives(items.withColumn("label", moved), lambda i: F.pmod(i, F.lit(50)) == 0)
