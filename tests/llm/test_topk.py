import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import topk

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("score", T.StringType()), T.StructField("pd", T.StringType()),
                       T.StructField("rank", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA)


def brute(rows, k, every):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % every == 0:
            s = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a)))[:k]
            out |= {(q, r, i, -n) for r, (n, i) in enumerate(s, 1)}
    return out


def run(spark, rows, every=10, **options):
    got = topk.topk_search(frame(spark, rows).repartition(3), lambda i: F.pmod(i, F.lit(every)) == 0, **options).collect()
    assert len({(r.query_id, r.rank) for r in got}) == len(got)
    return {tuple(r) for r in got}


@pytest.mark.parametrize("block", [3, 4096])
def test_equals_brute_force(spark, block):
    rng = random.Random(block)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(1, 300)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]                       # ties
    rows += [(1000, None), (1010, [1.0, None] * 4), (1020, [math.nan] * 8), (1030, [math.inf] * 8), (None, [1.0] * 8),
             (1040, []), (1050, [0.5, 0.25]), (1051, [1.0, -1.0]), (1060, [0.0] * 8), (1070, [50.0] * 8), (1080, [-3.0] * 8)]
    assert run(spark, rows, block=block, k=10) == brute(rows, 10, 10)


def test_few_rows_and_large_numbers(spark):
    assert run(spark, [(10, [1.0, 2.0])]) == set()
    rows = [(10, [1.0e6, 2.0]), (11, [3.0e6, -1.0]), (12, [-1.0, 5.0e5])]
    assert run(spark, rows, every=1) == brute(rows, 10, 1)
    df = frame(spark, [(1, [1.0])]).limit(0)
    assert topk.topk_search(df, lambda i: F.lit(True)).collect() == []
    huge = run(spark, [(10, [3.0e38, 1.0]), (11, [3.0e38, 1.0])], every=1)
    assert {r[3] for r in huge} == {2 ** 63 - 1}


def test_pivots_leave_candidates_out(monkeypatch):
    """In clustered data most products are never computed."""
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(20, 16))[rng.integers(0, 20, 2000)] * 1024 + rng.normal(size=(2000, 16)) * 20).astype(np.int64)
    pivots = topk.choose_pivots(v[:200], 24)
    pd = topk._distances(v, pivots)
    seen = []
    real = topk._scores
    monkeypatch.setattr(topk, "_scores", lambda x, q: seen.append(len(x)) or real(x, q))
    best = topk._Best(1, 10)
    norm = float(np.sqrt((pivots * pivots).sum(1)).max())
    topk._batch((np.asarray([-1]), v[:1], pd[:1], norm, None), best, np.arange(2000), v, [p.tobytes() for p in pd], 64)
    want = sorted((-int(s), i) for i, s in enumerate(v @ v[0]))[:10]
    assert list(zip(best.rows[0][0], best.rows[0][1])) == [(-s, i) for s, i in want]
    assert sum(seen) < 1000


def test_bounds_hold_where_distances_cancel(spark):
    """Long vectors a short distance apart: the computed distance may be 0."""
    rng = random.Random(2)
    base = [rng.gauss(0, 1) * 2.0 ** 16 for _ in range(6)]
    rows = [(i, [float(np.float32(c + rng.randrange(-3, 4) * 2.0 ** -3)) for c in base]) for i in range(200)]
    assert run(spark, rows, n_pivots=40, k=3) == brute(rows, 3, 10)


def test_search_starts_from_the_sample():
    rng = np.random.default_rng(4)
    v = rng.integers(-50, 50, (300, 5))
    got = topk.starting_scores(np.asarray([7, 1000]), v[[7, 8]], np.arange(300), v, 4)
    want = sorted(int(v[i] @ v[7]) for i in range(300) if i != 7)[-4]
    assert got[0] == want and got[1] == sorted(int(x @ v[8]) for x in v)[-4]
    assert topk.starting_scores(np.asarray([1]), v[:1], np.arange(3), v[:3], 4)[0] == -np.inf
