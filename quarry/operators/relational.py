"""Relational operators of the Q&A model: semi-joins for topic subsets,
enrichment joins, metadata and tag index aggregations.

Rows: J1-J6, J8, A1, A3-A7, A11, A16, W5, W9, W10.

Membership tests are ``left_semi`` joins (never literal IN-lists built on the
driver); Catalyst/AQE choose broadcast or sort-merge from runtime sizes.
Grouped lists are built with ``collect_list`` + ``array_sort`` per key — the
lists are per post/answer and bounded by that post's own size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def answers_of(answers: DataFrame, questions: DataFrame,
               parent_col: str = "parent_id", qid_col: str = "post_id") -> DataFrame:
    """Answers whose parent is one of the questions."""
    ids = questions.select(F.col(qid_col).alias(parent_col))
    return answers.join(ids, parent_col, "left_semi")


def comments_of(comments: DataFrame, questions: DataFrame, answers: DataFrame,
                qid_col: str = "post_id", aid_col: str = "answer_id") -> DataFrame:
    """Comments attached to a question or to an answer of the set."""
    ids = (questions.select(F.col(qid_col).alias("post_id"))
           .unionByName(answers.select(F.col(aid_col).alias("post_id"))))
    return comments.join(ids, "post_id", "left_semi")


def links_within(links: DataFrame, ids: DataFrame, id_col: str = "post_id") -> DataFrame:
    """Edges whose two ends are both in ``ids``."""
    s = ids.select(F.col(id_col).alias("src_id"))
    d = ids.select(F.col(id_col).alias("dst_id"))
    return links.join(s, "src_id", "left_semi").join(d, "dst_id", "left_semi")


def attach_enrichment(questions: DataFrame, snippets: DataFrame | None = None,
                      entities: DataFrame | None = None) -> DataFrame:
    """Left-join snippets (snippet_count, best) and entities; absent rows
    default to (0, null) and []."""
    out = questions
    if snippets is not None:
        out = out.join(snippets, "post_id", "left").withColumn(
            "snippet_count", F.coalesce("snippet_count", F.lit(0)))
    if entities is not None:
        out = out.join(entities, "post_id", "left").withColumn(
            "entities", F.coalesce("entities", F.array().cast("array<string>")))
    return out


def final_frames(clean: DataFrame, db: DataFrame, id_col: str) -> DataFrame:
    """Cleaned text joined with the table columns; a cleaned row without a
    table row fails the job that reads the result."""
    joined = clean.join(db.withColumn("_there", F.lit(True)), id_col, "left")
    missing = F.raise_error(F.lit(f"final_frames: cleaned rows without a table row ({id_col})")).cast("boolean")
    return joined.filter(F.when(F.col("_there").isNull(), missing).otherwise(F.lit(True))).drop("_there")


def index_dataset(clean_questions: DataFrame, index_ids: DataFrame,
                  id_col: str = "post_id") -> DataFrame:
    """The clean questions that are in the index id set."""
    return clean_questions.join(index_ids.select(id_col), id_col, "left_semi")


def linked_pairs(links: DataFrame, ids: DataFrame, id_col: str = "post_id") -> DataFrame:
    """DISTINCT (src, dst) with both ends in ``ids``."""
    return links_within(links, ids, id_col).select("src_id", "dst_id").distinct()


def token_frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A1: (token, freq) over whitespace tokens, most frequent first."""
    toks = df.select(F.explode(F.split(F.col(text_col), " ")).alias("token")).filter(
        F.col("token") != "")
    # global order via a range-partitioned sort (no single partition)
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("freq")) \
        .orderBy(F.col("freq").desc(), F.col("token"))


def merge_post_text(questions: DataFrame, answers: DataFrame, qtext: str = "body",
                    atext: str = "body") -> DataFrame:
    """A3: a question's text followed by its answers' texts, as ordered parts
    (post_id, ord, text): ord 0 is the question, answers follow by answer id.

    The parts are not concatenated into one value: a question holding a third
    of all answers would otherwise become one unbounded row.  Consumers that
    need the text in order read it by (post_id, ord)."""
    q = questions.select("post_id", F.lit(0).cast("bigint").alias("ord"), F.col(qtext).alias("text"))
    a = answers.select(F.col("parent_id").alias("post_id"), F.col("answer_id").cast("bigint").alias("ord"),
                       F.col(atext).alias("text"))
    return q.unionByName(a)


def distinct_entities(ents: DataFrame) -> DataFrame:
    """A4: (post_id, entities) distinct per post in first-seen order.

    Input rows (post_id, ord, entity).  Duplicates are removed first by a
    (post_id, entity) aggregation that keeps the first position (map-side
    combined), so the list built per post is bounded by its distinct entities."""
    first = ents.groupBy("post_id", "entity").agg(F.min("ord").alias("ord"))
    g = first.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("ord", "entity"))).alias("l"))
    return g.select("post_id", F.transform("l", lambda s: s["entity"]).alias("entities"))


def build_metadata(q: DataFrame) -> DataFrame:
    """A5: etags = set(tags u entities) without empties (sorted, see README),
    plus score, title and snippets."""
    from ..functions.text import parse_tags
    ents = F.coalesce(F.col("entities"), F.array().cast("array<string>")) \
        if "entities" in q.columns else F.array().cast("array<string>")
    etags = F.array_sort(F.array_distinct(F.filter(F.concat(parse_tags("tags"), ents),
                                                   lambda x: x != "")))
    cols = [F.col("post_id"), F.col("score"), F.col("title"), etags.alias("etags")]
    if "snippet_count" in q.columns:
        cols += [F.col("snippet_count"), F.col("best")]
    return q.select(*cols)


def build_etag_index(meta: DataFrame) -> DataFrame:
    """Inverted tag index as a pair table (etag, post_id) — linear in the
    number of tags and never one row per tag (a tag on a third of all posts
    would be an unbounded list).  Lookups are joins on etag."""
    return meta.select(F.explode("etags").alias("etag"), "post_id").distinct()


def etag_counts(index: DataFrame) -> DataFrame:
    """Posts per etag of the pair index (map-side combined count)."""
    return index.groupBy("etag").agg(F.count(F.lit(1)).alias("n_posts"))


def top_tags(results: DataFrame, meta: DataFrame, n: int = 8,
             qid: str = "query_id") -> DataFrame:
    """The n most frequent etags among each query's results (ties by tag)."""
    e = results.select(qid, "post_id").join(meta.select("post_id", "etags"), "post_id") \
        .select(qid, F.explode("etags").alias("tag"))
    c = e.groupBy(qid, "tag").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(qid).orderBy(F.col("n").desc(), F.col("tag"))
    r = c.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    return r.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("r", "tag"))).alias("l")) \
        .select(qid, F.transform("l", lambda s: s["tag"]).alias("top_tags"))


def postlink_frequencies(pairs: DataFrame, min_links: int = 2) -> DataFrame:
    """Appearances of each id over both ends of the distinct pairs."""
    p = pairs.select("src_id", "dst_id").distinct()
    ends = p.select(F.col("src_id").alias("post_id")).unionAll(p.select(F.col("dst_id")))
    return ends.groupBy("post_id").agg(F.count(F.lit(1)).alias("links")) \
        .filter(F.col("links") >= min_links)


def field_counts(index: DataFrame, field_col: str = "field") -> DataFrame:
    """Rows and distinct posts per index field."""
    return index.groupBy(field_col).agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.countDistinct("post_id").alias("n_posts"))


def top_by_score(df: DataFrame, n: int = 4000, score: str = "score",
                 id_col: str = "post_id") -> DataFrame:
    """The n best-scored rows (ties by id) — a planned TakeOrderedAndProject."""
    return df.orderBy(F.col(score).desc(), F.col(id_col)).limit(n)


def symmetric_pairs(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair, as a set."""
    p = pairs.select("src_id", "dst_id")
    return p.unionByName(p.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))) \
        .distinct()


def take_k(ranked: DataFrame, k: int, rank_col: str = "rank") -> DataFrame:
    """Cut ranked result sets to a smaller k."""
    return ranked.filter(F.col(rank_col) <= k)
