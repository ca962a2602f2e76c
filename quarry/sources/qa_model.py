"""The Q&A data model derived from the shared test tables.

The engine works on questions / answers / comments / post links.  The test
environment ships generic tables, so every model table is a lazy view derived
here (identically to the SQL oracle in ``quarry.oracle``).  All derivations
are narrow projections or equi-joins: nothing here is quadratic in any key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


# text-heavy tables whose per-row work (regexes, tokenising) dominates
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXT_TABLES:
        from ..plans.strategy import spread
        df = spread(df)
    return df


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """questions(post_id, title, body, tags, score, answer_count, accepted_answer_id)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("post_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        F.concat(F.lit("<"), "lang", F.lit("><"), "source", F.lit(">")).alias("tags"),
        ((F.col("n_chars") % 41) - 3).cast("int").alias("score"),
        (F.col("doc_id") % 4).cast("int").alias("answer_count"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("doc_id") * 100 + 1).alias("accepted_answer_id"),
    )


def answer_code(answer_id, turn) -> F.Column:
    """A Java fragment planted in answer bodies (fixture convention)."""
    return F.concat(
        F.lit("import java.util.Map;\nMap m = new HashMap();\nm.put(\"k"),
        answer_id.cast("string"), F.lit("\", "), turn.cast("string"),
        F.lit(");\nSystem.out.println(m.size());"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answers(answer_id, parent_id, body, score, turn): assistant turns.

    Bodies are HTML: the prose in <p>, and for two thirds of the answers a
    <pre><code> Java block (plus an inline <code> for some), so snippet and
    code operators have input.
    """
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    aid = F.col("conv_id") * 100 + F.col("turn")
    has_code = ((F.col("conv_id") + F.col("turn")) % 3) != 0
    inline = ((F.col("conv_id") + F.col("turn")) % 3) == 2
    body = F.concat(
        F.lit("<p>"), F.col("text"), F.lit("</p>"),
        F.when(has_code, F.concat(F.lit("<pre><code>"), answer_code(aid, F.col("turn")),
                                  F.lit("</code></pre>"))).otherwise(F.lit("")),
        F.when(inline, F.concat(F.lit("<p>then call <code>m.get(\"k"), aid.cast("string"),
                                F.lit("\")</code></p>"))).otherwise(F.lit("")))
    return c.select(
        aid.alias("answer_id"),
        F.col("conv_id").alias("parent_id"),
        body.alias("body"),
        (F.length("text") % 17).cast("int").alias("score"),
        F.col("turn"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """comments(comment_id, post_id, text, score): system turns."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "system")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("comment_id"),
        F.col("conv_id").alias("post_id"),
        F.col("text"),
        (F.length("text") % 5).cast("int").alias("score"),
    )


def postlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """postlinks(src_id, dst_id, link_type).

    Duplicates (type 3): every document whose md5(text) group has a smaller
    member links to the group's smallest id (a star, linear in group size —
    never all pairs of a group).  Related (type 1): (doc_id, doc_id + 20)
    when both share a source.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    h = d.select("doc_id", F.md5("text").alias("h"))
    heads = h.groupBy("h").agg(F.min("doc_id").alias("head"))
    dup = (h.join(heads, "h")
            .filter(F.col("doc_id") != F.col("head"))
            .select(F.col("doc_id").alias("src_id"), F.col("head").alias("dst_id"),
                    F.lit(3).alias("link_type")))
    a = d.select("doc_id", "source")
    b = d.select(F.col("doc_id").alias("d2"), F.col("source").alias("s2"))
    rel = (a.join(b, (F.col("d2") == F.col("doc_id") + 20) & (F.col("s2") == F.col("source")))
            .select(F.col("doc_id").alias("src_id"), F.col("d2").alias("dst_id"),
                    F.lit(1).alias("link_type")))
    return dup.unionByName(rel)


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """queries(query_id, text) from the benchmark table."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text"))


def dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense index in long form (post_id, field, vector, label): two fields =
    the first and second half of each embedding."""
    e = table(spark, sf_dir, "embeddings")
    title = e.select(F.col("vec_id").alias("post_id"), F.lit("title").alias("field"),
                     F.slice("embedding", 1, 32).alias("vector"), "label")
    body = e.select(F.col("vec_id").alias("post_id"), F.lit("body").alias("field"),
                    F.slice("embedding", 33, 32).alias("vector"), "label")
    return title.unionByName(body)


WORD_DIMS = 8


def word_vector_expr(token: F.Column) -> F.Column:
    """Deterministic 8-dim vector of a token: md5 hex digits, 4 per dim,
    scaled to [-0.5, 0.5] (fixture word-vector model)."""
    h = F.md5(token)
    return F.array(*[(F.conv(F.substring(h, 4 * i + 1, 4), 16, 10).cast("double") / 65535.0 - 0.5)
                     for i in range(WORD_DIMS)])


def word_vectors(spark: SparkSession, sf_dir: str, min_count: int = 2) -> DataFrame:
    """(token, vector): every white-space token that question titles and
    bodies hold ``min_count`` times, plus '<unk>'."""
    from ..operators.dense import space_tokens
    q = questions(spark, sf_dir)
    txt = q.select(F.explode(F.array("title", "body")).alias("t"))
    toks = txt.select(F.explode(space_tokens("t")).alias("token")).groupBy("token").count() \
        .filter(F.col("count") >= min_count).select("token")
    unk = spark.range(1).select(F.lit("<unk>").alias("token"))
    return toks.unionByName(unk).select("token", word_vector_expr(F.col("token")).alias("vector"))
