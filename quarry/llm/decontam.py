"""Benchmark decontamination by templates.

A text becomes a sequence of words in which numbers, names and units are typed
placeholders: numerals and number words, capitalised words (at a sentence's
start too, so that the template does not depend on layout), unit words.  Windows
of ``window`` template words are hashed; a join on the hash finds the documents
that hold enough of a benchmark item's windows.  For these the slots (the values
behind the placeholders) are compared: along one alignment every value of the
item must stand for one value of the document.  So "Ann has 3 pens" is found
again as "Bob has 7 pens", whereas text that merely has the same shape with its
values mixed up is not.  A document holds an item when it has ``min_cover`` of
the item's windows, or ``RUN`` words of it in a row along one alignment.

Word-for-word copies in any case and layout, of items of any length from
``SHORTEST`` words, are found beside this by plain chunks: every chunk of an item
meets the documents' chunks at every few words, and what meets is compared word
by word.  Here a run counts; items shorter than a run must be there whole.

Everything is DataFrame functions; there is no Python on the executors.

Defined results: null and empty texts hold no words; texts of any length are
read whole; items of fewer than ``SHORTEST`` words are too weak as evidence and
match nothing (``without_evidence`` lists them); items with equal templates count
as one, named by the smallest id, unless ``every_item`` is set: then each is
judged by its own values; of rows that repeat a doc_id the windows are taken
together; rows without a doc_id cannot be named and are not reported; of several
alignments the best is reported; empty tables give no rows; other columns are
ignored by ``contaminated`` and kept by ``clean``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, staged

MARK = "\x01"   # no word holds it
NAME, NUMBER, UNIT = MARK + "n", MARK + "d", MARK + "u"
_WORD = r"\p{N}+(?:[.,:/]\p{N}+)*|\p{L}+"
RUN = 13       # words in a row that are evidence however long the item is
SHORTEST = 4   # words of an item that can match at all
# Plain chunks: items of at least so many words; width; step of the documents'
# chunks.  A run of RUN words, or a whole item below that, holds one whole chunk
# wherever it begins: step + width - 1 words at most.
_CHUNKS = ((13, 8, 6), (7, 4, 4), (4, 4, 1))

# Fixed word lists, by type, in four languages; numerals are read by rule.
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven",
    "twelve", "twenty", "thirty", "forty", "fifty", "hundred", "thousand", "million",
    "null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "elf", "zwölf",
    "zwanzig", "dreißig", "vierzig", "fünfzig", "hundert", "tausend",
    "deux", "trois", "quatre", "cinq", "sept", "huit", "neuf", "dix", "onze", "douze", "vingt", "trente",
    "quarante", "cinquante", "cent", "mille",
    "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "once", "doce", "veinte", "treinta",
    "cuarenta", "cincuenta", "cien", "mil")
UNIT_WORDS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g",
    "kg", "gram", "grams", "kilogram", "kilograms", "ounce", "ounces", "pound", "pounds", "ml", "litre",
    "litres", "liter", "liters", "meter", "meters", "metre", "metres", "second", "seconds", "minute",
    "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "euro", "euros", "cents", "percent", "kmh", "mph",
    "heure", "heures", "jour", "jours", "semaine", "semaines", "mois", "an", "ans", "kilo", "kilos", "gramme", "grammes",
    "mètre", "mètres", "kilomètre", "kilomètres",
    "metro", "metros", "gramo", "gramos", "litro", "litros", "hora", "horas", "minuto", "minutos", "segundo",
    "segundos", "día", "días", "semana", "semanas", "mes", "meses", "año", "años", "kilómetro", "kilómetros", "dólar", "dólares")


def raw_words(text: Column) -> Column:
    """The words of a text as they stand; numerals keep their inner marks."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def typed(w: Column) -> Column:
    """A word's placeholder, or the word in lower case."""
    first, low = F.substring(w, 1, 1), F.lower(w)
    known = F.when(low.isin(*NUMBER_WORDS), F.lit(NUMBER))
    lower = known.when(low.isin(*UNIT_WORDS), F.lit(UNIT)).otherwise(low)
    return (F.when(first.between("a", "z"), lower)
            .when(first.between("A", "Z"), known.otherwise(F.lit(NAME)))
            .when(first.between("0", "9") | w.rlike(r"^\p{N}"), F.lit(NUMBER))
            .when(w.rlike(r"^\p{Lu}"), known.otherwise(F.lit(NAME))).otherwise(lower))


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once however often the body
    names it (a reused column expression would be computed each time)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def window_hashes(words: Column, window: int) -> Column:
    """The hashes of all windows of ``window`` (a power of two) words: pairs,
    pairs of pairs and so on, so a window costs log2(window) hashes."""
    if window & (window - 1) or window < 2:
        raise ValueError("window must be a power of two, 2 at least")

    def doubled(width: int):
        def body(a: Column) -> Column:
            return F.zip_with(a, F.slice(a, F.lit(width + 1), F.size(a)), lambda x, y: F.xxhash64(x, y))
        return body

    h, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < window:
        h, width = _let(h, doubled(width)), width * 2
    return _let(h, lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - (window - 1), F.lit(0))))


def _placeholder(w: Column) -> Column:
    return w.isin(NAME, NUMBER, UNIT)


_ITEM = ["item_id", "template", "variant"]


def item_table(items: DataFrame, id_col: str, text_col: str, every_item: bool = False) -> DataFrame:
    """item_id, template, variant, raw, words (template), n of the items that
    can match; one item per template, or all."""
    it = items.select(F.col(id_col).cast("long").alias("item_id"), raw_words(F.col(text_col).cast("string")).alias("raw")) \
        .filter(F.col("item_id").isNotNull() & (F.size("raw") >= SHORTEST))
    it = it.withColumn("words", F.transform("raw", typed))
    if every_item:
        it = it.distinct().withColumn("template", F.xxhash64("words")).withColumn("variant", F.xxhash64("raw"))
    else:
        it = it.groupBy("words").agg(F.min_by("raw", F.struct("item_id", F.array_join("raw", " "))).alias("raw"),
                                     F.min("item_id").alias("item_id")) \
            .withColumn("template", F.col("item_id")).withColumn("variant", F.lit(0).cast("long"))
    return it.select(*_ITEM, "raw", "words", F.size("raw").alias("n"))


def without_evidence(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, n_words of the items that are too short to match anything."""
    n = F.size(raw_words(F.col(text_col).cast("string")))
    return items.select(F.col(id_col).alias("item_id"), n.alias("n_words")).filter(F.col("n_words") < SHORTEST)


def item_windows(it: DataFrame, window: int, min_literals: int) -> DataFrame:
    """item_id, template, variant, ipos, h, slots (position, type, value) and
    n_windows of the windows that are evidence."""
    rows = _slot_windows(it.select(*_ITEM, "raw", "words"), window, "ipos")
    rows = rows.filter(F.lit(window) - F.size("slots") >= min_literals)
    per = rows.groupBy(*_ITEM).agg(F.count(F.lit(1)).alias("n_windows"))
    return rows.join(per, _ITEM).select(*_ITEM, "ipos", "h", "slots", "n_windows")


def _slot_windows(df: DataFrame, window: int, pos: str) -> DataFrame:
    """One row per window: its hash and its slots (offset, type, value)."""
    zipped = F.zip_with("words", "raw", lambda t, v: F.struct(t.alias("t"), F.lower(v).alias("v")))
    hashes = window_hashes(F.col("words"), window)
    one = df.withColumn("_z", zipped).select("*", F.posexplode(hashes).alias(pos, "h"))
    part = F.transform(F.slice("_z", F.col(pos) + 1, F.lit(window)),
                       lambda z, i: F.struct(i.alias("at"), z["t"].alias("t"), z["v"].alias("v")))
    return one.withColumn("slots", F.filter(part, lambda s: _placeholder(s["t"]))) \
        .drop("_z", "words", "raw")


def longest_run(places: Column) -> Column:
    """The most consecutive numbers in an array of distinct integers."""
    zero = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, p: Column) -> Column:
        now = F.when(p == acc["last"] + 1, acc["now"] + 1).otherwise(F.lit(1))
        return F.struct(p.alias("last"), now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.array_sort(places), zero, step, lambda acc: acc["most"])


def template_matches(src: DataFrame, it: DataFrame, window: int, min_literals: int, min_cover: float) -> DataFrame:
    """doc_id, item_id, template, variant, cover, n_slots, n_changed by typed windows."""
    bench = staged(item_windows(it, window, min_literals), "item-windows")
    in_a_row = max(1, RUN - window + 1)
    enough = F.col("found") >= F.col("n_windows") * F.lit(min_cover)

    # all documents: which of them hold enough windows of which template
    narrow = staged(bench.select("h", "template", "ipos", "n_windows").distinct(), "item-hashes")
    every = src.select("doc_id", F.explode(window_hashes(F.transform(raw_words(F.col("text")), typed), window)).alias("h"))
    hits = every.join(bounded(narrow), "h")
    pairs = (hits.groupBy("doc_id", "template", "ipos", "n_windows").agg(F.lit(1).alias("_one"))
             .groupBy("doc_id", "template", "n_windows").agg(F.count("_one").alias("found"))
             .filter(enough | (F.col("found") >= in_a_row)).select("doc_id", "template"))
    pairs = staged(pairs, "template-pairs")

    # these documents again, with the values behind the placeholders
    chosen = staged(pairs.select("doc_id").distinct(), "template-docs")
    held = src.join(bounded(chosen), "doc_id", "left_semi").select("doc_id", raw_words(F.col("text")).alias("raw"))
    windows = _slot_windows(held.select("doc_id", "raw", F.transform("raw", typed).alias("words")), window, "pos")
    wanted = bench.join(pairs.select("template").distinct(), "template", "left_semi") \
        .withColumnRenamed("slots", "islots")
    met = (windows.join(wanted, "h").join(pairs, ["doc_id", "template"], "left_semi")
           .withColumn("diag", F.col("pos") - F.col("ipos")))
    slots = met.select(
        "doc_id", *_ITEM, "n_windows", "diag", "ipos",
        F.explode_outer(F.transform("islots", lambda s, i: F.struct(
            (s["at"] + F.col("ipos")).alias("at"), s["t"].alias("t"), s["v"].alias("iv"),
            F.get("slots", i)["v"].alias("dv")))).alias("s"))
    along = slots.groupBy("doc_id", *_ITEM, "n_windows", "diag").agg(
        F.collect_set("ipos").alias("ipos"), F.count_distinct("s.t", "s.iv").alias("values"),
        F.count_distinct("s.t", "s.iv", "s.dv").alias("mappings"),
        F.count_distinct("s.at").alias("n_slots"),
        F.count_distinct(F.when(F.col("s.iv") != F.col("s.dv"), F.col("s.at"))).alias("n_changed"))
    fine = along.filter(F.col("values") == F.col("mappings")).withColumn("run", longest_run(F.col("ipos")))
    found = fine.groupBy("doc_id", *_ITEM, "n_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ipos")))).alias("found"), F.max("run").alias("run"),
        F.max_by("n_slots", F.size("ipos")).alias("n_slots"), F.max_by("n_changed", F.size("ipos")).alias("n_changed"))
    return found.filter(enough | (F.col("run") >= in_a_row)).select(
        "doc_id", *_ITEM, (F.col("found") / F.col("n_windows")).alias("cover"), "n_slots", "n_changed")


def chunk_hashes(raw: Column, width: int, step: int) -> Column:
    """(pos, h) of the chunks of ``width`` words, in lower case, at every ``step`` words."""
    n = F.size(raw)
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width, F.lit(step)), lambda i: F.struct(
        i.alias("pos"), F.xxhash64(F.lower(F.array_join(F.slice(raw, i + 1, F.lit(width)), " "))).alias("h"))))


def plain_matches(src: DataFrame, it: DataFrame, window: int) -> DataFrame:
    """doc_id, item_id, template, variant, cover, n_slots, n_changed (0) by
    word-for-word comparison: a run of ``RUN`` words, or the whole item."""
    grams = []
    for i, (least, width, _) in enumerate(_CHUNKS):
        own = it.filter(F.col("n") >= least)
        if i:
            own = own.filter(F.col("n") < _CHUNKS[i - 1][0])
        grams.append(own.select(F.lit(i).alias("kind"), *_ITEM, F.explode(chunk_hashes(F.col("raw"), width, 1)).alias("c"))
                     .select("kind", *_ITEM, F.col("c.pos").alias("ipos"), "c.h"))
    grams = staged(reduce(DataFrame.unionByName, grams), "item-chunks")
    kinds = [r.kind for r in grams.select("kind").distinct().collect()]   # three at most
    if not kinds:
        zero = F.lit(0).cast("long")
        return it.select(F.lit(0).cast("long").alias("doc_id"), *_ITEM, F.lit(0.0).alias("cover"), zero.alias("n_slots"),
                         zero.alias("n_changed")).limit(0)

    def of_kind(raw: Column, k: int) -> Column:
        return F.transform(chunk_hashes(raw, *_CHUNKS[k][1:]), lambda c: F.struct(
            F.lit(k).alias("kind"), c["pos"].alias("pos"), c["h"].alias("h")))

    def chunks(raw: Column) -> Column:
        return F.flatten(F.filter(F.array(*[of_kind(raw, k) for k in sorted(kinds)]), lambda r: r.isNotNull()))

    every = src.select("doc_id", F.explode(_let(raw_words(F.col("text")), chunks)).alias("c")) \
        .select("doc_id", "c.kind", "c.pos", "c.h")
    met = every.join(bounded(grams), ["kind", "h"]).select("doc_id", *_ITEM, (F.col("pos") - F.col("ipos")).alias("diag"))
    met = staged(met.distinct(), "chunk-pairs")

    chosen = staged(met.select("doc_id").distinct(), "chunk-docs")
    held = src.join(bounded(chosen), "doc_id", "left_semi").select("doc_id", raw_words(F.col("text")).alias("text_words"))
    both = held.join(met, "doc_id").join(bounded(it), _ITEM)
    # an alignment may begin before the text does
    same = F.filter(F.transform("raw", lambda w, i: F.when(
        (F.col("diag") + i >= 0) & (F.lower(w) == F.lower(F.get("text_words", F.greatest(F.col("diag") + i, F.lit(0))))), i)),
        lambda i: i.isNotNull())
    judged = both.select("doc_id", *_ITEM, "n", F.least(F.col("n"), F.lit(window)).alias("width"), same.alias("same"),
                         F.size(F.filter("words", _placeholder)).cast("long").alias("n_slots"))
    zero = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("found"))

    def step(acc: Column, p: Column) -> Column:
        now = F.when(p == acc["last"] + 1, acc["now"] + 1).otherwise(F.lit(1))
        return F.struct(p.alias("last"), now.alias("now"),
                        (acc["found"] + F.when(now >= F.col("width"), 1).otherwise(0)).alias("found"))

    found = F.aggregate("same", zero, step, lambda acc: acc["found"]) / (F.col("n") - F.col("width") + 1)
    good = judged.filter(longest_run(F.col("same")) >= F.least(F.col("n"), F.lit(RUN)))
    return good.select("doc_id", *_ITEM, found.alias("cover"), "n_slots", F.lit(0).cast("long").alias("n_changed"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", *, window: int = 8, min_literals: int = 4,
                 min_cover: float = 0.5, every_item: bool = False) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, cover (share
    of the item's windows found), n_slots, n_changed, kind (``verbatim`` or
    ``reparameterised``).  ``every_item``: items of one template are judged and
    reported one by one, not as the one of the smallest id."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .filter("doc_id is not null")
    it = staged(item_table(items, item_id, item_text, every_item), "benchmark")
    found = template_matches(src, it, window, min_literals, min_cover).unionByName(plain_matches(src, it, window))
    # an item, and an id that several item rows share, is named once, by its
    # closest match
    kind = F.when(F.col("n_changed") > 0, "reparameterised").otherwise("verbatim")
    best = F.max_by(F.struct("cover", "n_slots", "n_changed", kind.alias("kind")),
                    F.struct("cover", -F.col("n_changed"), "n_slots"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, unchanged."""
    ids = bounded(staged(found.select(F.col("doc_id").alias("held")).distinct(), "contaminated-docs"))
    return docs.join(ids, docs[id_col].cast("long") == ids["held"], "left_anti")
