"""Spelling variants: words one edit apart, by asymmetric q-chunks.

Of two words that one inserted, deleted or replaced code point sets apart, the
shorter (of words of equal length, each) contributes two disjoint chunks, its
halves.  One edit leaves one half as it was, in the other word at the same
place or one place further.  The other word contributes its positional grams of
the chunks' lengths; an intact first half can stand at place 0 only or, when the
second half is intact as well, at place 1, so that of the grams within shift
one those at the chunk's own place from the word's start (first half) or from
its end (second half) are enough, and only these are written.

Chunks and grams meet in an equi-join on their hash.  A list that would compare
more than ``list_pairs`` pairs is not joined: what the intact half leaves over is
again a word with one edit, so its members are listed anew by that half and a
half of the rest, and so on.  The last lists fix all code points but one and are
bounded by the alphabet.  No list is cut and no pair is lost.  Candidates are
verified by edit distance.

Defined results: null and empty texts hold no words; texts are read whole, runs
of any length included; a null id counts as the empty text in the rule on
deletions; rows that repeat an id or a text count each; ties are decided by
code-point order; words without a near word have a null form and are their own
root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = 7,
                min_count: int = 2, drop_every: int = 31) -> DataFrame:
    """word, n: lower-cased runs of letters of at least ``min_length`` code
    points that occur ``min_count`` times.  Where ``drop_every`` divides the
    crc32 of id and run, the run loses one code point first (0: never)."""
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER))
                           .otherwise(F.col("run")))
    if drop_every:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        rows = rows.select("run", h.alias("h"))
        at = F.pmod("h", F.length("run")).cast("int")
        without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        rows = rows.select(F.when(F.col("h") % drop_every == 0, without).otherwise(F.col("run")).alias("word"))
        rows = rows.filter(F.length("word") >= min_length)
    else:
        rows = rows.withColumnRenamed("run", "word")
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _halves(key: Column, rest: Column, shift: Column) -> Column:
    """The two list entries of a rest: (key, rest) with either half of the
    shorter word's rest put into the key.  ``shift`` is what the word is longer
    by than the shorter word."""
    m = F.length(rest) - shift
    h = F.floor(m / 2).cast("int")
    head, tail = F.substring(rest, F.lit(1), h), F.substring(rest, h + 1, F.length(rest))
    last = F.substring(rest, h + shift + 1, F.length(rest))
    before = F.substring(rest, F.lit(1), h + shift)
    return F.array(F.struct(F.xxhash64(key, m, F.lit(0), head).alias("key"), tail.alias("rest")),
                   F.struct(F.xxhash64(key, m, F.lit(1), last).alias("key"), before.alias("rest")))


def _listed(entries: DataFrame) -> DataFrame:
    """Every entry's two entries of the next level."""
    return entries.select("word", "n", "shift", F.explode(_halves(F.col("key"), F.col("rest"), F.col("shift"))).alias("e")) \
        .select("word", "n", "shift", "e.key", "e.rest")


def near_pairs(words: DataFrame, *, list_pairs: int = 4096) -> DataFrame:
    """a, a_n, b, b_n: each two of ``words`` (word, n) that differ by one edit, once."""
    shifts = F.explode(F.array(F.lit(0), F.lit(1))).alias("shift")  # as a chunk's and as a longer gram's word
    entries = words.select("word", "n", shifts).select("word", "n", "shift", (F.length("word") - F.col("shift")).cast("long")
                                                       .alias("key"), F.col("word").alias("rest"))
    found = []
    while True:
        entries = staged(_listed(entries), "chunks")
        sizes = entries.groupBy("key").agg(F.count(F.when(F.col("shift") == 0, 1)).alias("chunks"),
                                           F.count(F.lit(1)).alias("grams"),
                                           F.max(F.length("rest") - F.col("shift")).alias("left"))
        # a list of one word, or without chunks, has no pair
        sizes = staged(sizes.filter("chunks > 0 and grams > 1").select(
            "key", ((F.col("chunks") * F.col("grams") > list_pairs) & (F.col("left") > 1)).alias("split")), "lists")
        alive = entries.join(sizes, "key")
        light = alive.filter("not split")
        s, t = light.filter("shift = 0").alias("s"), light.alias("t")
        once = (F.col("t.shift") == 1) | (F.col("s.word") < F.col("t.word"))
        met = s.join(t, (F.col("s.key") == F.col("t.key")) & once
                     & (F.length("t.rest") - F.col("t.shift") == F.length("s.rest"))
                     & (F.levenshtein(F.col("s.word"), F.col("t.word"), 1) == 1))
        found.append(staged(met.select(F.col("s.word").alias("a"), F.col("s.n").alias("a_n"), F.col("t.word").alias("b"),
                                       F.col("t.n").alias("b_n")), "near"))
        if sizes.filter("split").isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()
        entries = staged(alive.filter("split").drop("split"), "heavy")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms.  Paths are doubled,
    so rounds grow with the logarithm of the longest chain."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = staged(now.join(nxt, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, *, ratio: int = 10, list_pairs: int = 4096) -> DataFrame:
    """One row per word of ``words`` (word, n): word, form (its near word of
    largest n, if that is ``ratio`` times the word's), root, n, n_near, form_n."""
    pairs = staged(near_pairs(words, list_pairs=list_pairs), "near-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"),
                                          F.col("a_n").alias("b_n")))
    best = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"),
                                 F.min(F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("b"))).alias("best"))
    rows = staged(words.join(best.withColumnRenamed("a", "word"), "word", "left")
                  .withColumn("good", -F.col("best.m") >= F.col("n") * ratio)
                  .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                          F.when(F.col("good"), F.col("best.b")).alias("form"),
                          F.when(F.col("good"), -F.col("best.m")).alias("form_n")), "forms")
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
                                                  "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ratio: int = 10,
                      list_pairs: int = 4096, **words) -> DataFrame:
    """``variants`` of the words of the texts; ``words`` goes to ``word_counts``."""
    return variants(staged(word_counts(docs, id_col, text_col, **words), "words"), ratio=ratio, list_pairs=list_pairs)
