import random

import pytest
import regex

from quarry.llm import decontam as D

from .conftest import frame, prose

RAW = regex.compile(r"\p{N}+(?:[.,:/]\p{N}+)*|\p{L}+")
SLOTS = (D.NAME, D.NUMBER, D.UNIT)


def template(t):
    """[(placeholder or word, value)]"""
    out = []
    for m in RAW.finditer(t or ""):
        w = m[0].lower()
        if regex.match(r"\p{N}", m[0]) or w in D.NUMBER_WORDS:
            kind = D.NUMBER
        elif regex.match(r"\p{Lu}", m[0]):
            kind = D.NAME
        else:
            kind = D.UNIT if w in D.UNIT_WORDS else w
        out.append((kind, w))
    return out


def longest(places):
    most = now = 0
    last = None
    for p in sorted(places):
        now = now + 1 if last is not None and p == last + 1 else 1
        most, last = max(most, now), p
    return most


def typed_match(it, texts, window, literals, cover):
    words = tuple(k for k, _ in it)
    places = [p for p in range(len(words) - window + 1) if sum(w not in SLOTS for w in words[p:p + window]) >= literals]
    diags = {}
    for doc in texts:
        kinds = [k for k, _ in doc]
        where = {}
        for q in range(len(doc) - window + 1):
            where.setdefault(tuple(kinds[q:q + window]), []).append(q)
        for p in places:
            for q in where.get(words[p:p + window], ()):
                got = diags.setdefault(q - p, [set(), set()])
                got[0].add(p)
                got[1] |= {(it[p + j], doc[q + j][1]) for j in range(window) if it[p + j][0] in SLOTS}
    fine = [g for g in diags.values() if len({a for a, _ in g[1]}) == len(g[1])]
    found = {p for g in fine for p in g[0]}
    if fine and (len(found) >= cover * len(places) or max(longest(g[0]) for g in fine) >= 13 - window + 1):
        return round(len(found) / len(places), 9)


def plain_match(it, texts):
    """Whether a run of 13 words, or the whole item, stands in a text."""
    a = [v for _, v in it]
    need = min(13, len(a))
    text = {tuple(v for _, v in t[q:q + need]) for t in texts for q in range(len(t) - need + 1)}
    return any(tuple(a[p:p + need]) in text for p in range(len(a) - need + 1))


def brute(rows, items, window=8, literals=4, cover=0.5, every_item=False):
    by = {}
    for i, t in sorted(items, key=lambda x: (x[0] is None, x[0], x[1] or "")):
        words = template(t)
        if i is not None and len(words) >= 4:
            by.setdefault((i, tuple(words)) if every_item else tuple(k for k, _ in words), (i, words))
    docs = {}
    for i, t in rows:
        if i is not None:
            docs.setdefault(i, []).append(template(t))
    return {(d, item): (typed_match(it, texts, window, literals, cover), plain_match(it, texts))
            for item, it in by.values() for d, texts in docs.items()
            if typed_match(it, texts, window, literals, cover) is not None or plain_match(it, texts)}


def items(spark, rows):
    return spark.createDataFrame([(*r, "z", "z") for r in rows], "item_id long, text string, doc_id string, h string")


def run(spark, rows, bench, **options):
    got = D.contaminated(frame(spark, rows), items(spark, bench), **options).collect()
    out = {(r.doc_id, r.item_id): r for r in got}
    assert len(out) == len(got)
    return out


Q = ("The baker told Ann that 12 loaves cost 30 dollars in total, and later Ann sold 5 loaves to Tom for "
     "12 dollars each before the shop closed for the night.")
Q2 = Q.replace("Ann", "Maria").replace("Tom", "Joe").replace("12", "7.5").replace("30", "1,000").replace("sold 5", "sold eleven")
MIXED = Q2.replace("Maria sold", "Eve sold")
STARTS = ("Ann has 12 red pens in a box. Ann buys 5 more red pens at the corner shop. Ann gives 3 pens to her "
          "brother. How many pens does Ann have now?")


def test_reparameterised_questions(spark):
    rng = random.Random(1)
    rows = [(1, prose(rng, 40) + " " + Q + " " + prose(rng, 40)), (2, prose(rng, 9) + " " + Q2), (3, MIXED), (4, prose(rng, 90)),
            (5, Q[:60]), (6, Q.upper())]
    got = {d: r.kind for (d, _), r in run(spark, rows, [(9, Q)]).items()}
    assert got == {1: "verbatim", 2: "reparameterised", 6: "verbatim"}


def test_names_at_the_start_of_a_sentence(spark):
    rows = [(1, STARTS.replace("Ann", "Bob")), (2, STARTS.lower()), (3, STARTS.replace(". ", ".\n\n").replace(" ", "  ")),
            (4, STARTS.replace("Ann", "Bob").replace("12", "40").replace("\n", " ")), (5, "İstanbul " + STARTS),
            (6, STARTS.replace("Ann gives", "Bob gives").replace("12", "9").replace("Ann buys", "Eve buys").replace("does Ann", "does Eve"))]
    got = {d: (r.kind, r.n_changed) for (d, _), r in run(spark, rows, [(1, STARTS)]).items()}
    assert {d: k for d, (k, _) in got.items()} == {1: "reparameterised", 2: "verbatim", 3: "verbatim", 4: "reparameterised",
                                                   5: "verbatim"}
    assert got[5] == ("verbatim", 0)


def test_short_items_and_long_quotations(spark):
    rng = random.Random(8)
    long_item = prose(rng, 200, 3000)
    cut = long_item.split()
    bench = [(1, "Who wrote War and Peace?"), (2, "What is 12 x 7 + 5?"), (3, "3 kg of 4 kg and 5 kg of 6 kg"), (4, long_item),
             (5, "too short now"), (6, "")]
    rows = [(10 + i, prose(rng, 21 + i, 3000) + f" {t} " + prose(rng, 20, 3000)) for i, t in
            enumerate(("who wrote war and peace", "What is 12 x 7 + 5?", "3 kg of 4 kg\nand 5 kg of 6 kg", " ".join(cut[70:130]),
                       " ".join(cut[40:53]), " ".join(cut[40:52]), "Who wrote war, peace", "What is 12 x 8 + 5?", "too short now"))]
    got = set(run(spark, rows, bench))
    assert got == {(10, 1), (11, 2), (12, 3), (13, 4), (14, 4)}
    assert [tuple(r) for r in D.without_evidence(items(spark, bench)).orderBy("item_id").collect()] == [(5, 3), (6, 0)]


def test_every_alignment_is_met(spark):
    """A run of 13 words, wherever it begins in the text."""
    rng = random.Random(2)
    item = prose(rng, 40, 3000)
    rows = [(i, prose(rng, i, 3000) + " " + " ".join(item.lower().split()[i:i + 13]) + " " + prose(rng, 5, 3000)) for i in range(1, 27)]
    short = "seven plain words make this item up"
    rows += [(100 + i, prose(rng, i, 3000) + " " + short.upper()) for i in range(12)]
    got = set(run(spark, rows, [(1, item), (2, short)]))
    assert got == {(i, 1) for i in range(1, 27)} | {(100 + i, 2) for i in range(12)}


def test_words_in_four_languages(spark):
    """Numerals, number words and units in other languages are slots too."""
    item = "der kleine hund frisst drei würste und läuft dann fünf kilometer durch den dunklen wald nach hause"
    copy = item.replace("drei", "sieben").replace("fünf", "12")
    assert {r.kind for r in run(spark, [(1, copy)], [(1, item)]).values()} == {"reparameterised"}


@pytest.mark.parametrize("every_item", [False, True])
def test_equals_brute_force(spark, odd_rows, every_item):
    rng = random.Random(4)
    bench = [(i, prose(rng, rng.randrange(3, 60))) for i in range(14)] + [(20, Q), (21, Q2), (22, None), (23, ""), (None, Q), (24, bench_copy())]
    rows = [(100 + i, prose(rng, rng.randrange(3, 60))) for i in range(30)]
    for i in range(40):
        b = rng.choice(bench)[1] or ""
        if rng.random() < 0.5:
            b = regex.sub(r"\d+", lambda m: str(rng.randrange(99)), b)
        cut = rng.randrange(0, max(1, len(b) // 3))
        if rng.random() < 0.2:
            b = b.upper()
        rows.append((200 + i, prose(rng, 12) + " " + b[cut:] + rng.choice([" ", ". "]) + prose(rng, 12)))
    rows += [(300, Q + " " + Q2), (301, Q2), (301, Q)] + odd_rows
    rows += [(400 + i, Q.replace("12", str(50 + i)).replace("30", "77")) for i in range(3)]
    got, want = run(spark, rows, bench, every_item=every_item), brute(rows, bench, every_item=every_item)
    assert set(got) == set(want)
    for k, (cover, plain) in want.items():
        assert got[k].kind == "verbatim" if plain and got[k].n_changed == 0 else True
        assert cover is None or got[k].cover >= cover - 1e-9
    assert sum(c is None for c, _ in want.values()) and sum(not p for _, p in want.values())


def bench_copy():
    return "3 kg of 4 kg and 5 kg of 6 kg and 7 kg of 8 kg"


def test_empty_tables_and_clean(spark):
    docs, bench = [(1, Q), (2, "clean text"), (None, Q)], [(1, Q)]
    df = frame(spark, docs)
    found = D.contaminated(df, items(spark, bench))
    kept = D.clean(df, found)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {2, None}
    assert D.contaminated(df.limit(0), items(spark, bench)).collect() == []
    assert D.contaminated(df, items(spark, bench).limit(0)).collect() == []
    assert D.contaminated(df, items(spark, [(1, "one two"), (2, None)])).collect() == []


def test_plan_is_native(spark):
    df = D.contaminated(frame(spark, [(1, Q)]), items(spark, [(1, Q)]))
    plan = df._jdf.queryExecution().toString()
    assert not [w for w in ("Python", "Arrow", "Pandas") if w in plan]


def test_items_of_one_template_are_judged_one_by_one(spark):
    same, other = Q.replace("5 loaves", "12 loaves"), Q.replace("5 loaves", "41 loaves").replace("30", "7").replace("told", "asked")
    same = same.replace("told", "asked")
    rows = [(1, other), (2, same), (3, "before it " + other.replace("Ann", "Eve"))]
    bench = [(1, same), (2, other), (2, other), (3, "something else altogether in eight or more plain words")]
    got = {k: (r.kind, r.n_changed) for k, r in run(spark, rows, bench, every_item=True).items()}
    assert got[1, 2] == ("verbatim", 0) and got[2, 1] == ("verbatim", 0) and got[3, 2][0] == "reparameterised"
    assert 3 not in {i for _, i in got}


def test_window_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        D.window_hashes(D.F.col("x"), 6)
