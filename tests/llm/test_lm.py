"""The model against a dictionary version of the same formulas."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import lm

from .conftest import frame, prose


def words(t):
    return (t or "").encode().lower().split()


def brute(train, texts):
    uni, bi = Counter(), Counter()
    for t in train:
        seq = words(t) + [None]
        uni.update(seq)
        bi.update(zip(["<s>"] + seq[:-1], seq))
    n, v = sum(uni.values()), len(uni)

    def discounts(counts):
        m = Counter(counts)
        y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0
        raw = [k - (k + 1) * y * m[k + 1] / m[k] if m[k] and m[k + 1] else k / 2 for k in (1, 2, 3)]
        return [0, *(min(max(x, 0.0), k) for k, x in enumerate(raw, 1))]

    before, follow = Counter(), defaultdict(Counter)
    for (a, b), c in bi.items():
        before[b] += 1
        follow[a][b] = c
    d2, d1 = discounts(bi.values()), discounts(before.values())
    types = len(bi)

    def p1(w):
        if not types:
            return 1 / (v + 1)
        rest = sum(d1[min(c, 3)] for c in before.values()) / types
        c = before.get(w, 0)
        return max(c - d1[min(c, 3)], 0) / types + rest / (v + 1)

    def p2(a, w):
        if a not in follow:
            return p1(w)
        total = sum(follow[a].values())
        back = sum(d2[min(c, 3)] for c in follow[a].values()) / total
        c = follow[a][w]
        return max(c - d2[min(c, 3)], 0) / total + back * p1(w)

    out = []
    for t in texts:
        seq = words(t) + [None]
        out.append((len(seq), sum(uni[w] > 0 for w in seq), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in seq),
                    sum(math.log10(p2(a, w)) for a, w in zip(["<s>"] + seq[:-1], seq))))
    return out, p2, [*uni, b"never seen"]


def rows_for(odd_rows):
    rng = random.Random(5)
    docs = [(100 + i, prose(rng, rng.randrange(1, 80), 60)) for i in range(80)]
    return docs + odd_rows + docs[:2]


def test_against_dictionaries(spark, odd_rows):
    rows = rows_for(odd_rows)
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    df = frame(spark, rows).repartition(5)
    from quarry.llm.common import fold
    got = lm.train_and_score(df, fold(F.col("doc_id"), 7) != 2, shard_bytes=20_000).collect()
    want, p2, vocab = brute([t for i, t in rows if not held(i)], [t for _, t in rows])
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    a = sorted((r.doc_id or 0, *key((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))) for r in got)
    b = sorted((i or 0, *key(w)) for (i, _), w in zip(rows, want))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:4] == y[:4]
        assert x[4:] == pytest.approx(y[4:], rel=1e-6)
    # the probabilities after a known word add up to one
    assert sum(p2(b"the", w) for w in vocab) == pytest.approx(1.0)


def test_empty_tables(spark):
    df = frame(spark, [(1, "a b"), (2, None)])
    assert lm.train_and_score(df.limit(0), F.lit(True)).collect() == []
    got = {r.doc_id: (r.n_tokens, r.train_tokens, r.base_score, r.score) for r in lm.train_and_score(df, F.lit(False)).collect()}
    assert got == {1: (3, 0, 0.0, 0.0), 2: (1, 0, 0.0, 0.0)}


def test_held_out_text_is_likelier_than_noise(spark):
    rng = random.Random(9)
    train = frame(spark, [(i, prose(rng, 100, 50)) for i in range(60)])
    model = lm.train(train)
    a, b = prose(rng, 100, 50), " ".join(rng.sample(prose(rng, 100, 50).split(), 100))
    got = {r.doc_id: r.score for r in lm.score(frame(spark, [(1, a), (2, "zz " * 100), (3, b)]), model).collect()}
    assert got[1] > got[2]
