import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import negatives

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("id", T.StringType()),
                       T.StructField("angles", T.StringType()), T.StructField("place", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "a", "b", "c") for i, v, label in rows], SCHEMA)


def brute(rows, every, n_positives=5, n_negatives=3):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows
          if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for a, x, label in ok:
        if a % every:
            continue
        s = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, y, other in ok if i != a and len(y) == len(x))
        for p, pid, _ in [r for r in s if r[2] == label][:n_positives]:
            fits = [(i, -n) for n, i, other in s if other != label and 50 * -p <= 100 * -n <= 95 * -p][:n_negatives]
            out |= {(a, pid, r, i, -p, n) for r, (i, n) in enumerate(fits, 1)}
    return out


def run(spark, rows, every=10, **options):
    got = negatives.hard_negatives(frame(spark, rows).repartition(3), lambda i: F.pmod(i, F.lit(every)) == 0, **options).collect()
    out = {tuple(r) for r in got}
    assert len(out) == len(got)
    return out


def clustered(seed, n, width=8):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, 0.4) for c in rng.choice(centres)], rng.randrange(4)) for i in range(1, n)]


ODD = [(1000, None, 1), (1010, [1.0, None] * 4, 1), (1020, [math.nan] * 8, 1), (1030, [math.inf] * 8, 1),
       (None, [1.0] * 8, 1), (1040, [], 1), (1041, [], 2), (1050, [0.5, 0.25], 1), (1051, [1.0, -1.0], 1),
       (1052, [0.45, 0.1], 2), (1053, [0.5, 0.0], 1), (1060, [0.0] * 8, 1), (1061, [0.0] * 8, 2), (1070, [50.0] * 8, 3),
       (1071, [49.0] * 8, 3), (1072, [40.0] * 8, 2), (1080, [-3.0] * 8, 1), (1090, [1.0] * 8, None), (1100, [1.0] * 8, 77)]


@pytest.mark.parametrize("block", [3, 2048])
def test_equals_brute_force(spark, block):
    rows = clustered(block, 300)
    rows += [(300 + i, rows[0][1], i % 4) for i in range(60)]     # ties
    want = brute(rows + ODD, 10)
    assert run(spark, rows + ODD, block=block) == want and len(want) > 100


def test_few_rows_and_large_numbers(spark):
    assert run(spark, [(10, [1.0, 2.0], 1)]) == set()
    assert negatives.hard_negatives(frame(spark, [(1, [1.0], 1)]).limit(0), lambda i: F.lit(True)).collect() == []
    rows = [(10, [3.0e6, 2.0], 1), (11, [3.0e6, -1.0], 1), (12, [2.0e6, 5.0e5], 2), (13, [2.9e6, 0.0], 2), (14, [2.8e6, 1.0], 2)]
    want = brute(rows, 1)
    assert run(spark, rows, every=1) == want and want
    big = [(1, [2.0e7, 1.0], 1), (2, [2.0e7, 3.0], 1), (3, [1.9e7, 3.0], 2)]   # products beyond 2^53
    assert run(spark, big, every=1) == brute(big, 1)


def test_repeated_ids(spark):
    """Of an anchor's rows the first counts; other rows are all candidates, and
    a positive of two rows is listed for each."""
    rows = clustered(4, 60) + [(10, [9.0] * 8, 2), (10, [9.0] * 8, 2)]
    first = min((r for r in rows if r[0] == 10), key=lambda r: (r[2], [math.floor(256 * float(np.float32(x))) for x in r[1]]))
    got = [tuple(r) for r in negatives.hard_negatives(frame(spark, rows), lambda i: F.pmod(i, F.lit(10)) == 0).collect()]
    assert {g for g in got if g[0] == 10} == {g for g in brute([r for r in rows if r[0] != 10] + [first], 10) if g[0] == 10}


def _bounds_hold(v, refs):
    u, norms = negatives.unit(v)
    angles = negatives.angles_to(u, refs)
    x = negatives.Rows(np.arange(len(v)), np.zeros(len(v), int), v, norms, angles)
    width = []
    for i in range(min(len(v), 40)):
        low, high = negatives.score_bounds(x, i, x, v.shape[1])
        s = [sum(int(p) * int(q) for p, q in zip(v[i], row)) for row in v]
        assert all(lo <= t <= hi for lo, t, hi in zip(low.tolist(), s, high.tolist()))
        width.append(np.mean((high - low) / (2 * norms[i] * norms + 2)))
    return np.mean(width)


@pytest.mark.parametrize("size", [1, 20, 2 ** 12, 2 ** 30, 2 ** 55])
def test_scores_never_leave_their_bounds(size):
    """Also for equal, opposite and nearly parallel vectors, where angles lose
    most to rounding."""
    rng = np.random.default_rng(size % 97)
    v = rng.integers(-size, size + 1, (120, 6))
    v[40:60] = v[:20]
    v[60:80] = -v[:20]
    v[80:100] = v[:20] + rng.integers(-1, 2, (20, 6))
    v[100] = 0
    u = negatives.unit(v)[0]
    refs = negatives.choose_references(u[(u != 0).any(1)], 12)
    assert _bounds_hold(v, refs) < 1.0
    assert _bounds_hold(v, u[:3][(u[:3] != 0).any(1)]) <= 1.0


def test_windows_leave_rows_out(monkeypatch):
    """In clustered data most rows are never scored."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) * 256
    v = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 8).astype(np.int64)
    u, norms = negatives.unit(v)
    refs = negatives.choose_references(u[:500], 16)
    x = negatives.Rows(np.arange(3000), np.zeros(3000, int), v, norms, negatives.angles_to(u, refs))
    low, high = negatives.score_bounds(x, 0, x, 16)
    exact = v @ v[0]
    top = int(np.sort(exact)[-20])
    window = negatives.window_of(top, 50, 95)
    rows = negatives.open_rows(low, high, [window], [negatives.Best(3)])
    inside = (exact >= window[0]) & (exact <= window[1])
    assert not (inside & ~rows).any() and rows.mean() < 0.5
    assert not negatives.open_rows(low, high, [negatives.window_of(-5, 50, 95)], [negatives.Best(3)]).any()
