import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quarry.llm import queries, variants

from .conftest import DOCS, frame


def plain_counts(rows, least=7, every=31):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def is_near(a, b):
    """Exactly one edit, by trying them all out of the longer word."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(n, ratio=10):
    near = defaultdict(list)
    shapes = defaultdict(set)   # words that share a shape are compared; one edit always leaves one
    for w in n:
        for i in range(len(w) + 1):
            shapes[w[:i] + w[i + 1:]].add(w)
    for group in shapes.values():
        for a in group:
            near[a] += [b for b in group if is_near(a, b)]
    out, form = {}, {}
    for w in n:
        best = min(set(near[w]), key=lambda b: (-n[b], b), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(set(near[w])), n[form[w]] if form[w] else None)
    return out


def table(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def noisy(rng, n):
    """Words of a small alphabet, so that many are near; misspelt copies."""
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 12))) for _ in range(60)]
    base += ["prefix" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    out = []
    for _ in range(n):
        w = base[int(len(base) * rng.random() ** 3)]
        if rng.random() < 0.15:
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abÿ") + w[i:], w[:i] + "z" + w[i + 1:]])
        out.append(w.upper() if rng.random() < 0.05 else w)
    return out


def texts(seed, n=12_000):
    rng = random.Random(seed)
    words = noisy(rng, n)
    rows, at = [], 0
    while at < len(words):
        k = rng.randrange(1, 400)
        rows.append((len(rows), rng.choice([" ", "1", "\n", "-"]).join(words[at:at + k])))
        at += k
    return rows


@pytest.mark.parametrize("list_pairs", [1, 50, 4096])
def test_equals_brute_force(spark, list_pairs):
    rows = texts(5)
    got = table(variants.spelling_variants(frame(spark, rows).repartition(3), list_pairs=list_pairs))
    want = plain_variants(plain_counts(rows))
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 50 and any(v[1] != (v[0] or w) for w, v in want.items())


def test_odd_rows(spark, odd_rows):
    rows = odd_rows + [(20, "×÷ÀÉabcde " * 3), (20, "straße straße straßen"), (None, "variant variant"),
                       (21, "Variante VARIANTE variante İstanbul İstanbul ſomething ſomething")]
    got = table(variants.spelling_variants(frame(spark, rows)))
    assert got == plain_variants(plain_counts(rows))
    assert variants.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []
    assert variants.spelling_variants(frame(spark, [(1, None), (2, ""), (3, "short words only")])).collect() == []


def test_a_large_family_is_split_into_small_lists(spark):
    """Words with one long first half: the list of that half is listed anew by
    what is left, and every pair is found all the same."""
    rng = random.Random(1)
    words = {"abcdefgh" + "".join(rng.choice("klmn") for _ in range(rng.choice([6, 7, 7, 7]))) for _ in range(900)}
    df = spark.createDataFrame([(w, 2 + i) for i, w in enumerate(sorted(words))], "word string, n long")
    pairs = {(r.a, r.b) for r in variants.near_pairs(df, list_pairs=100).collect()}
    want = {(a, b) for a in words for b in words if is_near(a, b) and (len(a), a) < (len(b), b)}
    assert pairs == want and len(want) > 20


def test_chains_of_forms(spark):
    chain = [f"w{'x' * i}word" for i in range(12)]
    df = spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string")
    assert {r.word: r.root for r in variants.roots(df).collect()} == {w: chain[-1] for w in chain[:-1]}


def test_without_deletions_and_other_limits(spark):
    rows = texts(9, 2000)
    df = variants.word_counts(frame(spark, rows), min_length=3, drop_every=0)
    assert {r.word: r.n for r in df.collect()} == plain_counts(rows, 3, 0)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op12_spelling_variants"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert table(got) == plain_variants(plain_counts(docs))
