"""Phrases and sub-sampling in token arrays: rows stay in their task."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import models as MD

STOP = ("of", "the")


def _docs(spark, ids):
    rng = random.Random(7)
    words = ["new", "york", "city", "état", "of", "the", "c++", "x_y"]
    rows = [(i, [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 9, 40]))] if rng.random() < 0.95 else None) for i in ids]
    return spark.createDataFrame(rows, "id long, tokens array<string>"), rows


def _brute(rows, least):
    n, pairs = Counter(), Counter()
    for _, t in rows:
        at = [i for i, w in enumerate(t or []) if w not in STOP]
        n.update(t[i] for i in at)
        pairs.update((t[i], " ".join(t[i + 1:j]), t[j]) for i, j in zip(at, at[1:]))
    return {(*p, n[p[0]], n[p[2]], c, round((c - least) * len(n) / (n[p[0]] * n[p[2]]), 9)) for p, c in pairs.items() if c >= least}


def _exchanges(df) -> bool:
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held", [0, 2_000_000])
def test_pairs_are_counted_as_in_a_plain_loop(spark, monkeypatch, held):
    from quarry.operators import spans
    monkeypatch.setattr(MD, "KNOWN_SPANS", held)
    monkeypatch.setattr(spans, "PIECE_TOKENS", 50)
    docs, rows = _docs(spark, range(60))
    got = MD.phrase_counts(docs, "tokens", 5, STOP)
    assert {(*r[:6], round(r.score, 9)) for r in got.collect()} == _brute(rows, 5)


@pytest.mark.parametrize("ids", [list(range(50)), [*range(30), 3, 3, 5, None, None, 40, 40]])
def test_phrases_are_merged_in_their_task(spark, ids):
    docs, _ = _docs(spark, ids)
    docs = MD.materialize(docs)
    found = MD.materialize(MD.phrase_counts(docs, "tokens", 5, STOP))
    got = MD.apply_phrases(docs, found, "id", threshold=0.001, connectors=STOP)
    want = MD._apply_by_windows(docs, found.filter("score > 0.001").select("a", "mid", "b").distinct(), "id", "tokens", "_", STOP)
    as_rows = lambda df: Counter((r.id, tuple(r.tokens)) for r in df.collect())
    assert as_rows(got) == as_rows(want) and any("_" in w and w != "x_y" for r in got.collect() for w in r.tokens)
    if len(set(ids)) == len(ids):
        assert not _exchanges(got)


@pytest.mark.parametrize("ids", [list(range(50)), [*range(30), 3, 3, 5, None, None, 40, 40]])
def test_tokens_are_thinned_out_in_their_task(spark, ids):
    docs, _ = _docs(spark, ids)
    docs = MD.materialize(docs)
    n = docs.select(F.explode("tokens").alias("token")).groupBy("token").count()
    total = n.agg(F.sum("count")).first()[0]
    chance = MD.keep_probability(F.col("count") / F.lit(float(total)), 0.02)
    got = MD.subsample(docs, "id", threshold=0.02, salt="s")
    want = MD._subsample_by_shuffle(docs, n.select("token", chance.alias("_p")), "id", "tokens", "s")
    as_rows = lambda df: Counter((r.id, tuple(r.tokens)) for r in df.collect())
    assert as_rows(got) == as_rows(want) and sum(len(r.tokens) for r in got.collect()) < total
    if len(set(ids)) == len(ids):
        assert not _exchanges(got)
