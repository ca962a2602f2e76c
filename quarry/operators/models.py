"""Model operators: vocabulary, classifier, word vectors, clustering, phrases.

Rows: A10, T31, A12, A15, V5, V6, V14, V15, V16, V17, V18, V19, V20, V21,
E7, E8, E9, E10.

Training uses MLlib estimators (distributed, JVM-side); feature tables are
built with native column expressions.  Nothing is collected to the driver
except bounded model statistics.
"""

from __future__ import annotations

import itertools
import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, CountVectorizer, CountVectorizerModel, HashingTF, StringIndexer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import classifier_tokens
from ..plans.strategy import block_count, checked_broadcast, global_rank, lookup, materialize
from . import spans

OOV_ID, TOP_TOKENS, MAX_LEN = 11999, 12000, 4000


# ------------------------------------------------------------------ A10 / T31
def build_token_dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A10: (token, id) ids 1..V by descending frequency over the classifier
    tokens (ties by token).  The rank is computed from a range-partitioned
    global sort (no single-partition window)."""
    toks = docs.select(F.explode(classifier_tokens(text_col)).alias("token"))
    freq = toks.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    return global_rank(freq, [F.col("freq").desc(), F.col("token")], "id").select("token", "id", "freq")


def encode_and_pad(docs: DataFrame, dictionary: DataFrame, id_col: str, text_col: str = "text",
                   oov: int = OOV_ID, top: int = TOP_TOKENS, max_len: int = MAX_LEN) -> DataFrame:
    """Token ids (OOV -> ``oov``), ids >= ``top`` dropped, left-padded
    with 0 / left-truncated to ``max_len``."""
    t = docs.select(id_col, F.posexplode(classifier_tokens(text_col)).alias("pos", "token"))
    j = t.join(checked_broadcast(dictionary.select("token", "id")), "token", "left").select(
        id_col, "pos", F.coalesce("id", F.lit(oov)).alias("id")).filter(F.col("id") < top)
    seq = j.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("l"))
    ids = F.transform("l", lambda x: x["id"].cast("int"))
    n = F.size(ids)
    kept = F.when(n > max_len, F.slice(ids, n - max_len + 1, max_len)).otherwise(ids)
    padded = F.concat(F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(max_len) - F.size(kept))), kept)
    out = seq.select(id_col, padded.alias("ids"))
    empty = docs.select(id_col).join(out.select(id_col), id_col, "left_anti") \
        .select(id_col, F.array_repeat(F.lit(0), max_len).alias("ids"))
    return out.unionByName(empty)


# ------------------------------------------------------------------ A12 / A15 / V21
def cluster_sample(assign: DataFrame, n: int = 20, cluster_col: str = "cluster",
                   token_col: str = "token") -> DataFrame:
    """The first n tokens (alphabetical) of each cluster — a per-group
    limit (WindowGroupLimit), never a whole cluster collected."""
    w = Window.partitionBy(cluster_col).orderBy(token_col)
    return assign.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r")


def content_pairs(tokens: Column, connectors: tuple[str, ...] = ()) -> Column:
    """Array of (a, mid, b, start, end) for neighbouring content words of a
    token array: connector words stand between them (``mid``, joined by
    spaces) and never start or end a pair; start and end are positions."""
    placed = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
                      lambda x: ~x["t"].isin(*connectors) if connectors else F.lit(True))
    bound = F.transform(F.array(placed), lambda u: F.zip_with(
        F.slice(u, F.lit(1), F.greatest(F.size(u) - 1, F.lit(0))),
        F.slice(u, F.lit(2), F.greatest(F.size(u) - 1, F.lit(0))),
        lambda x, y: F.struct(
            x["t"].alias("a"),
            F.array_join(F.slice(tokens, x["i"] + 2, y["i"] - x["i"] - 1), " ").alias("mid"),
            y["t"].alias("b"), x["i"].alias("start"), y["i"].alias("end"))))
    return F.get(bound, F.lit(0))


def repeated_ids(docs: DataFrame, id_col: str) -> DataFrame | None:
    """The ids that several rows of ``docs`` share, and null; None if there are none."""
    n = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    found = materialize(n.filter((F.col("_n") > 1) | F.col(id_col).isNull()).select(F.col(id_col).alias("_id")))
    return None if found.isEmpty() else found


def row_by_row(docs: DataFrame, id_col: str, alone, together) -> DataFrame:
    """``alone`` of the rows whose id no other row has, and ``together`` of the
    others, whose tokens are one sequence per id."""
    found = repeated_ids(docs, id_col)
    if found is None:
        return alone(docs)
    found = checked_broadcast(found)
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    return alone(docs.join(found, same, "left_anti")).unionByName(together(docs.join(found, same, "left_semi")))


# Digests and phrases that every task may hold.
KNOWN_SPANS = 2_000_000


def phrase_counts(docs: DataFrame, tokens_col: str = "tokens", min_count: int = 40,
                  stop: tuple[str, ...] = ()) -> DataFrame:
    """(a, mid, b, n_a, n_b, n_ab, score) for neighbouring content words;
    stop words connect a pair ("state of the art") instead of ending it and are
    not counted themselves; score = (n_ab - min_count) * V / (n_a * n_b) with V
    the number of distinct content words; pairs with n_ab >= min_count.

    ``docs`` holds one token array per sequence: pairs are formed inside each
    row, so tokens are never shuffled by sequence.  Pairs are counted as digests
    first, and as words where their digest occurs often enough: most pairs are
    rare, and only a number of each is shuffled."""
    toks = F.col(tokens_col)
    words = docs.select(F.explode(toks).alias("token"))
    if stop:
        words = words.filter(~F.col("token").isin(*stop))
    # unigram counts are used three times (vocabulary size, two joins):
    # materialised once (vocabulary-sized)
    uni = materialize(words.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    vocab, occurrences = uni.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows, connectors = docs.select(toks.alias("tokens")), frozenset(stop)
    parts = block_count(occurrences, spans.TASK_SPANS)
    digests = rows.mapInArrow(spans.count_digests("tokens", connectors, parts), spans.PACKED)
    often = materialize(digests.groupBy("part").applyInArrow(spans.often_digests(parts, min_count), "h long"))
    wanted = None
    if often.count() <= KNOWN_SPANS:
        wanted = np.sort(often.toArrow()["h"].to_numpy())
    pairs = rows.mapInArrow(spans.count_spans("tokens", connectors, wanted), "h long, a string, mid string, b string, n long")
    if wanted is None:
        pairs = pairs.join(often, "h", "left_semi")
    bi = pairs.groupBy("a", "mid", "b").agg(F.sum("n").alias("n_ab")).filter(F.col("n_ab") >= min_count)
    ua = uni.select(F.col("token").alias("a"), F.col("n").alias("n_a"))
    ub = uni.select(F.col("token").alias("b"), F.col("n").alias("n_b"))
    j = checked_broadcast(bi).join(ua, "a")
    j = checked_broadcast(j).join(ub, "b")
    return j.select("a", "mid", "b", "n_a", "n_b", "n_ab",
                    ((F.col("n_ab") - min_count) * F.lit(float(vocab)) / (F.col("n_a") * F.col("n_b")))
                    .alias("score"))


def apply_phrases(docs: DataFrame, phrases: DataFrame, id_col: str, tokens_col: str = "tokens",
                  threshold: float = 10.0, joiner: str = "_", connectors: tuple[str, ...] = ()) -> DataFrame:
    """Greedy left-to-right merge of pairs that score over ``threshold``
    into one token, connectors between them included.

    Of a run of overlapping candidate pairs the first, third, fifth ... are
    merged, which is what a walk from the left does.  Rows are merged in their
    task, which holds the phrases; rows that share an id, and all if there are
    more phrases than a task may hold, are merged by windows instead."""
    docs = docs.select(id_col, tokens_col)
    good = materialize(phrases.filter(F.col("score") > threshold).select("a", "mid", "b").distinct())

    def together(rows):
        return _apply_by_windows(rows, good, id_col, tokens_col, joiner, connectors)

    if good.count() > KNOWN_SPANS:
        return together(docs)
    known = frozenset(zip(*good.toArrow().to_pydict().values()))
    merge = spans.merge_spans(id_col, tokens_col, frozenset(connectors), known, joiner)
    return row_by_row(docs, id_col, lambda rows: rows.mapInArrow(merge, rows.schema), together)


def _apply_by_windows(docs: DataFrame, good: DataFrame, id_col: str, tokens_col: str, joiner: str,
                      connectors: tuple[str, ...]) -> DataFrame:
    """V21 over windows of the candidates of an id: the work is linear in the
    length of a text."""
    toks = F.col(tokens_col)
    pairs = docs.select(id_col, F.posexplode(content_pairs(toks, tuple(connectors))).alias("u", "p")) \
        .select(id_col, "u", "p.a", "p.mid", "p.b", "p.start", "p.end")
    cand = pairs.join(good, ["a", "mid", "b"], "left_semi")
    by_doc = Window.partitionBy(id_col).orderBy("u")
    runs = cand.withColumn("_run", F.col("u") - F.row_number().over(by_doc))
    place = F.row_number().over(Window.partitionBy(id_col, "_run").orderBy("u"))
    merged = runs.withColumn("_place", place).filter(F.col("_place") % 2 == 1)
    glued = merged.select(id_col, F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("pos"),
                          F.lit(True).alias("_glued"))
    rows = docs.select(id_col, F.posexplode(toks).alias("pos", "token")).join(glued, [id_col, "pos"], "left")
    seq = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(
        "pos", "token", F.coalesce("_glued", F.lit(False)).alias("g")))).alias("l"))
    # a separator that no white-space token can hold stands before every new token
    text = F.array_join(F.transform("l", lambda x: F.concat(F.when(x["g"], F.lit(joiner)).otherwise(F.lit("\n")), x["token"])), "")
    out = seq.select(id_col, F.split(F.substring(text, F.lit(2), F.length(text)), "\n").alias(tokens_col))
    none = docs.select(id_col).join(out.select(id_col), id_col, "left_anti")
    return out.unionByName(none.withColumn(tokens_col, F.array().cast("array<string>")))


def merge_phrases(docs: DataFrame, id_col: str, tokens_col: str = "tokens", min_count: int = 40,
                  threshold: float = 10.0, connectors: tuple[str, ...] = (), passes: int = 2) -> DataFrame:
    """V21 in full: pairs are merged, then counted and merged again over the
    merged sequences, so that phrases of three and four content words form.
    The sequences are materialised before and between the passes."""
    out = materialize(docs.select(id_col, tokens_col), "zstd")
    for i in range(passes):
        counts = phrase_counts(out, tokens_col, min_count, tuple(connectors))
        out = apply_phrases(out, counts, id_col, tokens_col, threshold, connectors=tuple(connectors))
        if i + 1 < passes:
            out = materialize(out, "zstd")
    return out


# ------------------------------------------------------------------ V5 / V6 / V14 / V15 / V19
def train_skipgram(sentences: DataFrame, tokens_col: str = "tokens", dim: int = 300,
                   window: int = 10, min_count: int = 5, max_iter: int = 24, seed: int = 1200,
                   partitions: int | None = None):
    """V5: MLlib Word2Vec (skip-gram, hierarchical softmax); defaults follow
    the original configuration (300 dims, window 10, min count 5, 24 epochs).
    Sub-sampling is a step of its own (``subsample``), drawn once and not anew
    per epoch.

    Training runs in as many partitions as the input has (``partitions``
    overrides), whose models are averaged after each epoch.  MLlib keeps the
    vocabulary x dim x 2 matrix on the driver and in every task: that, not the
    corpus, bounds the memory (``min_count`` is the handle on it)."""
    n = partitions or max(1, sentences.rdd.getNumPartitions())
    return Word2Vec(vectorSize=dim, windowSize=window, minCount=min_count, maxIter=max_iter, numPartitions=n,
                    seed=seed, inputCol=tokens_col, outputCol="_v").fit(sentences)


def keep_probability(share: Column, threshold: float) -> Column:
    """V5 sub-sampling: sqrt(t / f) + t / f of a word's share f of all tokens,
    1 at most."""
    x = F.lit(threshold) / share
    return F.least(F.sqrt(x) + x, F.lit(1.0))


def subsample(docs: DataFrame, id_col: str, tokens_col: str = "tokens", threshold: float = 1e-6, salt: str = "") -> DataFrame:
    """V5 sub-sampling: (id, tokens) with frequent words thinned out.

    An occurrence stays when the hash of its text and position (eight hex digits
    of an MD5, as a number in [0, 1)) lies below its word's keep probability: the
    same rows give the same sample, wherever they are read.  Word counts are
    combined per task.  Only words over a share of the threshold / 0.382 can be
    left out, so few that every task holds them: tokens stay in their task, but
    for rows that share an id."""
    docs = docs.select(id_col, tokens_col)
    counts = materialize(docs.select(F.explode(tokens_col).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    share = F.col("n") / F.lit(float(total))
    # a word that always stays is not looked up
    drawn = materialize(counts.select("token", keep_probability(share, threshold).alias("_p")).filter(F.col("_p") < 1.0))

    def together(rows):
        return _subsample_by_shuffle(rows, drawn, id_col, tokens_col, salt)

    if drawn.count() > KNOWN_SPANS:
        return together(docs)
    known = drawn.toArrow().to_pydict()
    thin = spans.thin_out(id_col, "_key", tokens_col, known["token"], known["_p"])
    key = F.concat(F.lit(salt), F.col(id_col).cast("string")).alias("_key")
    return row_by_row(docs, id_col, lambda rows: rows.select(id_col, key, tokens_col).mapInArrow(thin, rows.schema), together)


def _subsample_by_shuffle(docs: DataFrame, drawn: DataFrame, id_col: str, tokens_col: str, salt: str) -> DataFrame:
    toks = docs.select(id_col, F.posexplode(tokens_col).alias("pos", "token"))
    key = F.concat(F.lit(salt), F.col(id_col).cast("string"), F.lit(":"), F.col("pos").cast("string"))
    u = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    left = toks.join(checked_broadcast(drawn), "token", "left").filter(u < F.coalesce(F.col("_p"), F.lit(1.0)))
    g = left.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_l"))
    out = g.select(id_col, F.transform("_l", lambda x: x["token"]).alias(tokens_col))
    none = docs.select(id_col).join(out.select(id_col), id_col, "left_anti")
    return out.unionByName(none.withColumn(tokens_col, F.array().cast("array<string>")))


# Q17: character n-grams of a word with its ends marked
SUBWORD_SIZES = (3, 4, 5, 6)


def character_grams(word: Column, sizes: tuple[int, ...] = SUBWORD_SIZES) -> Column:
    """The distinct n-grams of '<word>'."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))
    n = F.length(marked)

    def of_size(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(marked, i, F.lit(k))))

    return F.array_distinct(F.flatten(F.filter(F.array(*[of_size(k) for k in sizes]), lambda a: a.isNotNull())))


def vector_size(vectors: DataFrame) -> int:
    """The numbers that the longest vector of a table has."""
    return vectors.agg(F.max(F.size("vector"))).first()[0] or 0


def subword_table(vectors: DataFrame, buckets: int = 2_000_000, sizes: tuple[int, ...] = SUBWORD_SIZES) -> DataFrame:
    """Q17: (bucket, vector): per hashed character n-gram the mean of the unit
    vectors of the words that hold it."""
    from .dense import unit_normalize, vector_means
    vectors = materialize(vectors.select("token", unit_normalize("vector").alias("vector")))
    grams = vectors.select(F.explode(character_grams(F.col("token"), sizes)).alias("g"), "vector")
    return vector_means(grams.select(F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket"), "vector"), ["bucket"], vector_size(vectors))


def unseen_word_vectors(words: DataFrame, table: DataFrame, word_col: str = "token", buckets: int = 2_000_000,
                        sizes: tuple[int, ...] = SUBWORD_SIZES) -> DataFrame:
    """Q17: (word, vector) of words without a vector of their own: the mean of
    their n-grams' vectors.  A word of which no n-gram is known has no row.

    The n-grams are many times the words, by whose size Spark would judge them
    small and broadcast them: both sides of the join are shuffled instead."""
    from .dense import vector_means
    table = materialize(table)
    grams = words.select(word_col).distinct().select(word_col, F.explode(character_grams(F.col(word_col), sizes)).alias("g"))
    met = grams.select(word_col, F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket")).join(table.hint("merge"), "bucket")
    return vector_means(met, [word_col], vector_size(table))


def word_vector_table(model) -> DataFrame:
    """(token, vector array<float>) from a Word2Vec model."""
    return model.getVectors().select(F.col("word").alias("token"),
                                     vector_to_array("vector", "float32").alias("vector"))


def vocab_filtered_tokens(docs: DataFrame, id_col: str, tokens_col: str,
                          vocab: DataFrame) -> DataFrame:
    """Token arrays keeping only vocabulary tokens (order kept; removed
    tokens do not count for distances).  A semi-join, so the vocabulary is
    never broadcast unchecked."""
    ex = docs.select(id_col, F.posexplode(tokens_col).alias("pos", "token"))
    kept = ex.join(checked_broadcast(vocab.select("token")), "token", "left_semi")
    g = kept.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("l"))
    return g.select(id_col, F.transform("l", lambda x: x["token"]).alias(tokens_col))


# Pairs of a task, which it adds up in memory before they are shuffled.
TASK_PAIRS = 4_000_000


def _numbered(docs: DataFrame, tokens_col: str) -> tuple[DataFrame, DataFrame]:
    """(token, no) of the distinct tokens, the commonest first, and the token
    arrays as arrays of numbers, in as many partitions as their tokens take."""
    rows = materialize(docs.select(F.col(tokens_col).alias("tokens")).withColumn("_d", F.monotonically_increasing_id()))
    each = rows.select("_d", F.posexplode("tokens").alias("pos", "token"))
    words = each.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    words = materialize(global_rank(words, [F.col("_n").desc(), F.col("token")], "no")
                        .select("token", F.col("no").cast("int").alias("no")))
    tasks = block_count(rows.agg(F.sum(F.size("tokens"))).first()[0] or 0, TASK_PAIRS // 10)
    seen = lookup(each, words, "token").groupBy("_d").agg(F.array_sort(F.collect_list(F.struct("pos", "no"))).alias("l"))
    return words, seen.select("_d", F.transform("l", lambda x: x["no"]).alias("nos")).repartition(tasks, "_d")


def cooccurrence_counts(docs: DataFrame, tokens_col: str, window: int = 10) -> DataFrame:
    """V6: GloVe co-occurrence x(a, b) = sum over pairs within ``window`` of
    1/distance, symmetric.  Pairs are generated inside each row from the
    token array (no self join), then summed with a map-side combined
    aggregation (hot pairs are pre-aggregated per task before the shuffle).

    Words are numbers while pairs are counted, and each pair is counted once for
    both directions, as one number; the words come back after the sums."""
    words, numbered = _numbered(docs, tokens_col)
    nos = F.col("nos")
    n = F.size(nos)

    def pairs_at(d):
        a = F.slice(nos, 1, F.greatest(n - d, F.lit(0)))
        b = F.slice(nos, d + 1, F.greatest(n - d, F.lit(0)))
        return F.zip_with(a, b, lambda x, y: F.struct(
            (F.shiftleft(F.least(x, y).cast("long"), 32) + F.greatest(x, y)).alias("ab"), (F.lit(1.0) / d).alias("w")))
    allp = F.flatten(F.array(*[pairs_at(d) for d in range(1, window + 1)]))
    once = numbered.select(F.inline(allp)).groupBy("ab").agg(F.sum("w").alias("x"))
    once = once.select(F.shiftright("ab", 32).cast("int").alias("na"), F.col("ab").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("nb"), "x")
    known = checked_broadcast(words, 5_000_000)
    named = once.join(known.select(F.col("no").alias("na"), F.col("token").alias("a")), "na") \
        .join(known.select(F.col("no").alias("nb"), F.col("token").alias("b")), "nb")
    both = F.when(F.col("na") == F.col("nb"), F.array(F.struct("a", "b", (2 * F.col("x")).alias("x")))).otherwise(
        F.array(F.struct("a", "b", "x"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "x")))
    return named.select(F.inline(both))


def positive_pmi(cooc: DataFrame) -> DataFrame:
    """(a, b, ppmi) = max(0, ln(x(a,b) * x(.,.) / (x(a,.) * x(.,b)))) of the
    co-occurrence weights; pairs at 0 are left out.  Marginals are aggregations
    joined on their word, broadcast behind a check of their size; the grand
    total is one number."""
    cooc = materialize(cooc)
    pa = checked_broadcast(cooc.groupBy("a").agg(F.sum("x").alias("xa")), 5_000_000)
    pb = checked_broadcast(cooc.groupBy("b").agg(F.sum("x").alias("xb")), 5_000_000)
    total = cooc.agg(F.sum("x")).first()[0] or 0.0
    pmi = F.log(F.col("x") * F.lit(total) / (F.col("xa") * F.col("xb")))
    return cooc.join(pa, "a").join(pb, "b").select("a", "b", pmi.alias("ppmi")).filter(F.col("ppmi") > 0)


def glove_factorize(cooc: DataFrame, rank: int = 300, max_iter: int = 10,
                    reg: float = 0.05, seed: int = 1200) -> DataFrame:
    """V6 (factorisation, substitute for the GloVe solver): MLlib ALS on the
    positive PMI of the co-occurrence counts; word vector = user factor + item
    factor.  Token ids come from the distributed global rank (no driver-side
    vocabulary); words without a positive entry have no vector."""
    from pyspark.ml.recommendation import ALS
    ppmi = materialize(positive_pmi(cooc))
    vocab = materialize(global_rank(ppmi.select(F.col("a").alias("token")).distinct(), [F.col("token")], "tid")
                        .select("token", F.col("tid").cast("int").alias("tid")))
    va = vocab.select(F.col("token").alias("a"), F.col("tid").alias("ia"))
    vb = vocab.select(F.col("token").alias("b"), F.col("tid").alias("ib"))
    r = ppmi.join(va, "a").join(vb, "b").select("ia", "ib", F.col("ppmi").alias("r"))
    model = ALS(rank=rank, maxIter=max_iter, regParam=reg, userCol="ia", itemCol="ib",
                ratingCol="r", seed=seed, nonnegative=False).fit(r)
    u = model.userFactors.select(F.col("id").alias("tid"), F.col("features").alias("u"))
    v = model.itemFactors.select(F.col("id").alias("tid"), F.col("features").alias("v"))
    j = vocab.join(u, "tid").join(v, "tid")
    return j.select("token", F.zip_with("u", "v", lambda x, y: x + y).alias("vector"))


def kmeans_assign(vectors: DataFrame, k: int, id_col: str, vector_col: str = "vector",
                  seed: int = 1200, max_iter: int = 20) -> DataFrame:
    """MLlib KMeans (k-means|| init) and the cluster of every row."""
    model, v = kmeans_fit(vectors, k, id_col, vector_col, seed, max_iter)
    return model.transform(v).select(id_col, F.col("prediction").alias("cluster"))


def kmeans_fit(vectors: DataFrame, k: int, id_col: str, vector_col: str = "vector",
               seed: int = 1200, max_iter: int = 20):
    """The KMeans model and the feature rows it was fitted on."""
    v = vectors.select(id_col, array_to_vector(vector_col).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=max_iter).fit(v), v


def compound_embeddings(word_vectors: DataFrame, ks=(500, 1000, 1500, 2000, 3000),
                        min_freq_tokens: DataFrame | None = None,
                        seed: int = 1200) -> DataFrame:
    """Token -> map(k -> cluster id) over several k, for the tokens of
    ``min_freq_tokens`` when given.  The vectors are computed once for all k."""
    wv = word_vectors if min_freq_tokens is None else word_vectors.join(min_freq_tokens, "token", "left_semi")
    wv = materialize(wv)
    out = None
    for k in ks:
        a = kmeans_assign(wv, k, "token", seed=seed).select("token", F.lit(k).alias("k"), "cluster")
        out = a if out is None else out.unionByName(a)
    return out.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("k", "cluster")))
                                    .alias("clusters"))


def pca_project(vectors: DataFrame, n: int, id_col: str, vector_col: str = "vector") -> DataFrame:
    """MLlib PCA projection to n components, or to all that the vectors
    have if these are fewer."""
    n = min(n, vectors.agg(F.max(F.size(vector_col))).first()[0] or 1)
    v = vectors.select(id_col, array_to_vector(vector_col).alias("features"))
    model = PCA(k=n, inputCol="features", outputCol="_p").fit(v)
    return model.transform(v).select(id_col, vector_to_array("_p").alias("projection"))


def tag_groups(tags: Column, highlight: tuple[str, ...], max_tags: int = 5) -> Column:
    """The first highlighted tag of a post with <= max_tags tags; else
    the tag list joined by spaces."""
    hl = F.array(*[F.lit(h) for h in highlight])
    first = F.try_element_at(F.filter(tags, lambda t: F.array_contains(hl, t)), F.lit(1))
    return F.when((F.size(tags) <= max_tags) & first.isNotNull(), first).otherwise(F.array_join(tags, " "))


# ------------------------------------------------------------------ V16 / V17 / V18 / E7-E10
def noise_pipeline(vocab_size: int = 12000, reg: float = 0.01, max_iter: int = 50) -> Pipeline:
    """Classifier tokens -> counts -> logistic regression."""
    return Pipeline(stages=[
        CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=vocab_size, minDF=1.0),
        LogisticRegression(featuresCol="features", labelCol="label", regParam=reg, maxIter=max_iter)])


def with_tokens(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("tokens", classifier_tokens(text_col))


def train_post_classifier(labelled: DataFrame, text_col: str = "text", **kw):
    """Fit on (text, label) rows; label 1 = noise."""
    return noise_pipeline(**kw).fit(with_tokens(labelled, text_col))


def predict_noise(model, df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rounded 0/1 prediction for every row (no hand batching)."""
    return model.transform(with_tokens(df, text_col)).withColumn(
        "pred", F.col("prediction").cast("int")).drop("tokens", "features", "rawPrediction",
                                                      "probability", "prediction")


def classifier_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                       eps: float = 1e-7) -> DataFrame:
    """Precision, recall, f1 of the positive class (epsilon-guarded) and accuracy."""
    tp = F.sum(F.when((F.col(label) == 1) & (F.col(pred) == 1), 1).otherwise(0))
    fp = F.sum(F.when((F.col(label) == 0) & (F.col(pred) == 1), 1).otherwise(0))
    fn = F.sum(F.when((F.col(label) == 1) & (F.col(pred) == 0), 1).otherwise(0))
    acc = F.avg(F.when(F.col(label) == F.col(pred), 1.0).otherwise(0.0))
    g = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), acc.alias("accuracy"))
    p = F.col("tp") / (F.col("tp") + F.col("fp") + eps)
    r = F.col("tp") / (F.col("tp") + F.col("fn") + eps)
    return g.select("tp", "fp", "fn", "accuracy", p.alias("precision"), r.alias("recall"),
                    (2 * p * r / (p + r + eps)).alias("f1"))


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 1200, label: str = "label",
                     id_col: str = "id") -> DataFrame:
    """fold = (rank within label by a seeded hash) mod k, so every fold
    gets the label mix of the whole set (counts per fold differ by <= 1);
    deterministic for a seed.

    The rank is a distributed global rank over (label, hash, id) minus the
    number of rows of smaller labels — no window partitioned by label (one
    label may hold most rows)."""
    h = df.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed)))
    g = global_rank(h, [F.col(label), F.col("_h"), F.col(id_col)], "_g")
    counts = h.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(label, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per label value
    out = g.join(F.broadcast(offs), label)
    return out.withColumn("fold", ((F.col("_g") - F.col("_off") - 1) % k).cast("int")) \
        .drop("_h", "_g", "_off")


MEASURES = ("accuracy", "precision", "f1")


def training_words(data: DataFrame, k: int, most: int) -> list[list[str]]:
    """Per fold the ``most`` commonest words of the rows of all other folds, ties
    by word.  One count per word and fold serves all of them; ``most`` words per
    fold reach the driver, as they do in each ``CountVectorizer``."""
    each = data.select("fold", F.explode("tokens").alias("token")).groupBy("token", "fold").agg(F.count(F.lit(1)).alias("n"))
    own = [F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("n"))), F.lit(0)).alias(f"n{f}") for f in range(k)]
    counts = materialize(each.groupBy("token").agg(F.sum("n").alias("n"), *own))
    others = [(F.col("n") - F.col(f"n{f}")).alias("n") for f in range(k)]
    return [[r[0] for r in counts.select("token", o).filter("n > 0").orderBy(F.desc("n"), "token").limit(most).collect()]
            for o in others]


def out_of_fold(df: DataFrame, settings: list[dict], k: int = 5, seed: int = 1200, id_col: str = "id",
                parallelism: int = 4) -> DataFrame:
    """(setting, fold, id, label, pred): every row predicted once per
    setting (arguments of ``noise_pipeline``) by a model of the other folds.
    The folds are stratified and the same for all settings, and so are the words
    of a fold's training rows, which are counted once for all models."""
    data = materialize(stratified_folds(with_tokens(df).select(id_col, "label", "tokens"), k, seed, id_col=id_col))
    parts = [{type(x): x for x in noise_pipeline(**s).getStages()} for s in settings]
    sizes = [p[CountVectorizer].getVocabSize() for p in parts]
    words = training_words(data, k, max(sizes))

    def fitted(job):
        i, fold = job
        count = parts[i][CountVectorizer]
        if not words[fold]:
            raise ValueError("the training rows of a fold have no words")
        counted = CountVectorizerModel.from_vocabulary(words[fold][:sizes[i]], count.getInputCol(), count.getOutputCol())
        model = parts[i][LogisticRegression].fit(counted.transform(data.filter(F.col("fold") != fold)))
        return model.transform(counted.transform(data.filter(F.col("fold") == fold))).select(
            F.lit(i).alias("setting"), "fold", F.col(id_col), F.col("label").cast("int").alias("label"),
            F.col("prediction").cast("int").alias("pred"))

    # independent Spark jobs, submitted side by side
    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(fitted, itertools.product(range(len(settings)), range(k))))
    return materialize(reduce(DataFrame.unionByName, parts))


def fold_scores(predictions: DataFrame, eps: float = 1e-7) -> DataFrame:
    """(setting, <measure>_mean, <measure>_std) of accuracy, precision
    and f1 over the folds, all measures from one pass over the predictions; std
    is that of the folds as a whole population."""
    def n(label, pred):
        return F.sum(((F.col("label") == label) & (F.col("pred") == pred)).cast("long"))

    f = predictions.groupBy("setting", "fold").agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = tp / (tp + fp + eps), tp / (tp + fn + eps)
    f = f.select("setting", "fold", ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), p.alias("precision"),
                 (2 * p * r / (p + r + eps)).alias("f1"))
    return f.groupBy("setting").agg(*[g(m).alias(f"{m}_{name}") for m in MEASURES
                                      for name, g in (("mean", F.avg), ("std", F.stddev_pop))])


def grid(**choices) -> list[dict]:
    """All combinations of the given values, in the order of the arguments."""
    return [dict(zip(choices, values)) for values in itertools.product(*choices.values())]


def cross_validate(df: DataFrame, settings: list[dict] | None = None, k: int = 5, seed: int = 1200,
                   measure: str = "accuracy", id_col: str = "id"):
    """Cross-validation of every setting; returns (best setting by
    ``measure``, ties to the first; scores per setting; predictions)."""
    settings = settings or grid(reg=[0.01, 0.1], vocab_size=[2000, 12000])
    predictions = out_of_fold(df, settings, k, seed, id_col)
    scores = materialize(fold_scores(predictions))
    best = scores.orderBy(F.desc(f"{measure}_mean"), "setting").first()   # one row per setting
    return settings[best["setting"]], scores, predictions


def is_held_out(id_col, fraction: float = 0.2, salt: str = "") -> Column:
    """Whether a row belongs to the held-out part: the first eight hex
    digits of the MD5 of its id, taken modulo 1000, lie below the fraction."""
    digest = F.md5(F.concat(F.lit(salt), F.col(id_col).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1000 < int(fraction * 1000)


def holdout_predictions(df: DataFrame, test_fraction: float = 0.2, id_col: str = "id", **setting) -> DataFrame:
    """The held-out rows with the predictions of a model of the others."""
    held = is_held_out(id_col, test_fraction)
    return predict_noise(train_post_classifier(df.filter(~held), **setting), df.filter(held))


def holdout_evaluate(df: DataFrame, test_fraction: float = 0.2, id_col: str = "id", **setting) -> DataFrame:
    """Deterministic hash split, train, evaluate on the held-out part."""
    return classifier_metrics(holdout_predictions(df, test_fraction, id_col, **setting))


def train_token_tagger(features: DataFrame, tag_col: str = "tag", num_features: int = 1 << 18):
    """Multinomial logistic regression over hashed template features."""
    return Pipeline(stages=[
        StringIndexer(inputCol=tag_col, outputCol="label", handleInvalid="keep"),
        HashingTF(inputCol="features", outputCol="hf", numFeatures=num_features),
        LogisticRegression(featuresCol="hf", labelCol="label", family="multinomial", maxIter=30),
    ]).fit(features)


def tag_tokens(model, features: DataFrame) -> DataFrame:
    """Predicted tag of every token."""
    labels = model.stages[0].labels
    lab = F.array(*[F.lit(x) for x in labels])
    out = model.transform(features)
    return out.withColumn("pred_tag", F.element_at(lab, F.col("prediction").cast("int") + 1)) \
        .drop("hf", "rawPrediction", "probability", "prediction", "label")


# log odds of a step that the tag scheme forbids
_NEVER = -1e9


def may_follow(prev: str | None, tag: str) -> bool:
    """Whether ``tag`` may follow ``prev`` (None: the sentence begins): an I-x
    follows a B-x or an I-x only."""
    return not tag.startswith("I-") or prev in ("B-" + tag[2:], tag)


def tag_transitions(tagged: DataFrame, labels: list[str], seq_keys: list[str], tag_col: str = "tag",
                    smoothing: float = 1.0) -> tuple[list[float], list[list[float]]]:
    """Log odds of the first tag of a sentence, and of tag j after tag i,
    against how often j occurs at all, counted over the training sentences with
    additive smoothing; steps that the scheme forbids are ruled out.  One row
    per pair of tags reaches the driver."""
    w = Window.partitionBy(*seq_keys).orderBy("pos")
    pairs = tagged.select(F.lag(tag_col).over(w).alias("prev"), F.col(tag_col).alias("tag"))
    n = {(r["prev"], r["tag"]): r["count"] for r in pairs.groupBy("prev", "tag").count().collect()}
    total = sum(n.values()) + smoothing * len(labels)
    share = {b: (sum(c for (_, x), c in n.items() if x == b) + smoothing) / total for b in labels}

    def odds(a, b):
        if not may_follow(a, b):
            return _NEVER
        among = sum(n.get((a, x), 0) + smoothing for x in labels if may_follow(a, x))
        return math.log((n.get((a, b), 0) + smoothing) / among / share[b])

    return [odds(None, b) for b in labels], [[odds(a, b) for b in labels] for a in labels]


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def best_path(emissions: Column, start: list[float], steps: list[list[float]]) -> Column:
    """The indices of the tags of the best path through a sentence.
    ``emissions``: one array of scores per token, a score per tag.

    A forward fold keeps the best score that ends in each tag and, per token,
    the tag each came from; a backward fold follows these from the best end."""
    into = F.array(*[F.array(*[F.lit(float(row[j])) for row in steps]) for j in range(len(start))])

    def best(scores: Column) -> Column:
        """The best (score, place); ties go to the first tag."""
        pairs = F.transform(scores, lambda v, i: F.struct(v.alias("v"), (-i).alias("i")))
        return F.array_max(pairs)

    def forward(acc: Column, e: Column) -> Column:
        came = F.transform(into, lambda col: best(F.zip_with(acc["scores"], col, lambda a, b: a + b)))
        return _let(came, lambda c: F.struct(
            F.zip_with(c, e, lambda x, y: x["v"] + y).alias("scores"),
            F.concat(acc["back"], F.array(F.transform(c, lambda x: -x["i"]))).alias("back")))

    first = F.zip_with(F.get(emissions, F.lit(0)), F.array(*[F.lit(float(x)) for x in start]), lambda a, b: a + b)
    init = F.struct(first.alias("scores"), F.array().cast("array<array<int>>").alias("back"))
    rest = F.slice(emissions, F.lit(2), F.greatest(F.size(emissions) - 1, F.lit(0)))
    done = F.aggregate(rest, init, forward)
    # the path is built from its end; reversed once at the end
    return _let(done, lambda d: F.reverse(F.aggregate(
        F.reverse(d["back"]), F.array(-best(d["scores"])["i"]),
        lambda path, row: F.concat(path, F.array(F.get(row, F.element_at(path, -1)))))))


def tag_sequences(model, features: DataFrame, seq_keys: list[str], start: list[float],
                  steps: list[list[float]]) -> DataFrame:
    """(seq_keys, pos, token, pred_tag): the best sequence of tags of every
    sentence, by the model's log probabilities of the tags and the log odds of
    the steps between them (``tag_transitions``)."""
    lab = F.array(*[F.lit(x) for x in model.stages[0].labels])
    n = len(model.stages[0].labels)
    scored = model.transform(features).select(
        *seq_keys, "pos", "token", F.transform(F.slice(vector_to_array("probability"), 1, n),
                                               lambda p: F.log(F.greatest(p, F.lit(1e-30)))).alias("e"))
    sents = scored.groupBy(*seq_keys).agg(F.array_sort(F.collect_list(F.struct("pos", "token", "e"))).alias("t"))
    paths = sents.select(*seq_keys, "t", best_path(F.transform("t", lambda x: x["e"]), start, steps).alias("path"))
    each = paths.select(*seq_keys, F.explode(F.zip_with("t", "path", lambda t, j: F.struct(
        t["pos"].alias("pos"), t["token"].alias("token"), F.get(lab, j).alias("pred_tag")))).alias("x"))
    return each.select(*seq_keys, "x.pos", "x.token", "x.pred_tag")
