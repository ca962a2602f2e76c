import hashlib
import random
import re

import pytest

from quarry.llm import repeats
from quarry.llm.queries import QUERIES

from .conftest import frame, prose


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_units(text, unit):
    """(start, end, words) by looking at every character."""
    if unit == "sentence":
        out, words = [], []

        def close():
            now = []
            for j, (s, e) in enumerate(words):
                now.append((s, e))
                w = lower(text[s:e])
                if j + 1 == len(words) or len(words) > 16 and hashlib.md5(w.encode()).hexdigest()[0] in "01":
                    out.append((now[0][0], now[-1][1], [lower(text[a:b]) for a, b in now]))
                    now = []
            words.clear()

        at = None
        for i, c in enumerate(text + "\n"):
            end = c in ".!?\n"
            if (end or c in " \t\r\x0b\x0c") and at is not None:
                words.append((at, i))
                at = None
            elif not end and c not in " \t\r\x0b\x0c" and at is None:
                at = i
            if end:
                close()
        return out
    out, at = [], 0
    for part in re.split(r"(\n)" if unit == "line" else r"(\n[\x20\t\r\x0b\x0c]*\n[\x20\x09-\x0D]*)", text):
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(part)) if w]
        if ws:
            out.append((at, at + len(part), ws))
        at += len(part)
    return out


def brute(rows, min_words, unit):
    every = []
    for i, t in rows:
        us = plain_units(t or "", unit)
        for a in range(len(us)):
            b, words = a, []
            while b < len(us) and len(words) < min_words:
                words += us[b][2]
                b += 1
            if len(words) >= min_words:
                every.append((2 ** 63 - 1 if i is None else i, a, us[a:b], " ".join(words)))
    first, out = {}, []
    for i, a, members, key in sorted(every, key=lambda x: x[:2]):
        start, end = members[0][0], members[-1][1]
        kept = first.setdefault(key, (i, a, end))
        if (i, a) == kept[:2] or i == kept[0] and start < kept[2]:
            continue
        out.append((i, a, start, end, sum(len(m[2]) for m in members), hashlib.md5(key.encode()).hexdigest(), *kept[:2]))
    return sorted(out)


def corpus(odd_rows):
    rng = random.Random(6)
    passage = "\n".join(prose(rng, 9) for _ in range(7))
    inline = prose(rng, 70)
    flat = " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(50)) for _ in range(90))
    lines = [prose(rng, rng.choice([1, 3, 12, 30])) for _ in range(12)]
    rows = [(100 + i, "\n".join(rng.choice([rng.choice(lines), prose(rng, 10), "", "  "]) for _ in range(8))) for i in range(60)]
    rows += [(200, "start here\n" + passage + "\nend"), (201, passage.upper().replace(" ", "  ")), (202, "fresh words\n" + passage)]
    for i in range(210, 216):   # begins and ends inside lines
        rows.append((i, f"{prose(rng, 25)} {inline if i % 2 else flat} {prose(rng, 25)}\n{prose(rng, 30)}"))
    rows += [(220, "same line again here!\n" * 40), (221, "It is so. " * 30), (222, "x... y?! z " * 20)]
    return rows + odd_rows


@pytest.mark.parametrize("unit,min_words", [("line", 1), ("line", 20), ("sentence", 1), ("sentence", 20), ("paragraph", 5)])
def test_equals_brute_force(spark, odd_rows, unit, min_words):
    rows = corpus(odd_rows)
    df = frame(spark, rows).repartition(4)
    got = sorted(tuple(r) for r in repeats.repeated_units(df, unit=unit, min_words=min_words).collect())
    assert got == brute(rows, min_words, unit)
    assert unit == "paragraph" or len(got) > 50


def test_passages_inside_lines(spark):
    """Every passage of over 50 words is found, wherever it begins and ends,
    with and without punctuation, and clean texts are left alone."""
    rng = random.Random(11)
    rows, planted, clean = [], set(), set()
    for n in range(40):
        words = prose(rng, 60, 5000) if n % 2 else " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
        for copy in range(2):
            doc = len(rows)
            rows.append((doc, f"{prose(rng, 40, 5000)} {words} {prose(rng, 40, 5000)}"))
            if copy:
                planted.add(doc)
            else:
                clean.add(doc)
        rows.append((len(rows), "Yes. No. " + prose(rng, 80, 5000) + " Yes."))
        clean.add(len(rows) - 1)
    found = repeats.repeated_units(frame(spark, rows)).collect()
    docs = {r.doc_id for r in found}
    assert len(docs & planted) >= 0.95 * len(planted) and not docs & clean
    text = dict(rows)
    for r in found:
        words = lower(text[r.doc_id][r.start:r.end]).split()
        kept = plain_units(text[r.kept_doc_id], "sentence")[r.kept_unit_no:]
        assert 20 <= len(words) == r.n_words
        assert [w.strip(".") for w in words] == [w for u in kept for w in u[2]][:len(words)]


def test_paragraphs(spark):
    rows = [(1, "a b c\nd\n\ne f"), (2, "x\n \t\n\nA  b c d"), (3, "a b c\nd")]
    got = sorted(tuple(r)[:4] for r in repeats.repeated_units(frame(spark, rows), unit="paragraph", min_words=1).collect())
    assert got == [(2, 1, 6, 14), (3, 0, 0, 7)]


def test_passage_of_short_lines_goes_and_short_lines_stay(spark):
    rng = random.Random(3)
    passage = "\n".join(prose(rng, 9) for _ in range(7))
    rows = [(1, "Yes.\n" + passage), (2, prose(rng, 30) + "\n" + passage), (3, "Yes.\n" + prose(rng, 40))]
    df = frame(spark, rows)
    found = repeats.repeated_units(df)
    assert {r.doc_id for r in found.collect()} == {2}
    cleaned = repeats.remove(df, found)
    assert cleaned.columns == df.columns
    text = {r.doc_id: r.text for r in cleaned.collect()}
    assert text[1] == rows[0][1] and text[3] == rows[2][1] and text[2] == rows[1][1].split("\n")[0] + "\n"


def test_removal_keeps_all_rows(spark, odd_rows):
    df = frame(spark, odd_rows)
    out = repeats.remove(df, repeats.repeated_units(df))
    assert out.count() == len(odd_rows) and sum(r.text is None for r in out.collect()) == 2
    empty = df.limit(0)
    assert repeats.remove(empty, repeats.repeated_units(empty)).collect() == []


def test_cut():
    assert repeats.cut("a\nb\nc", [2], [3]) == "a\nc"
    assert repeats.cut("a\nb\nc", [4, 0], [5, 1]) == "b\n"
    assert repeats.cut("One is. Two is! Three.\nFour", [8], [14]) == "One is. Three.\nFour"
    assert repeats.cut("One is. Two is.\nThree", [8], [14]) == "One is. \nThree"
    assert repeats.cut("a b c d e", [0, 2, 4], [3, 5, 7]) == "e"


def test_every_later_occurrence_is_reported(spark, tmp_path):
    rows = [(1, "Home | About\nfirst text"), (2, "second text\nHome | About\nthird"), (3, "home |  about")]
    frame(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.unit_no, r.kept_doc_id) for r in QUERIES["op10_later_occurrences"](spark, str(tmp_path)).collect())
    assert got == [(2, 1, 1), (3, 0, 1)]


def test_a_hot_digest_is_joined_apart(spark):
    """One line in more rows than a key may have in the shuffled join."""
    rows = [(i, f"The licence line that all have\nown text {i}") for i in range(1500)]
    got = repeats.repeated_units(frame(spark, rows), unit="line", min_words=1).collect()
    assert sorted((r.doc_id, r.unit_no, r.kept_doc_id) for r in got) == [(i, 0, 0) for i in range(1, 1500)]
