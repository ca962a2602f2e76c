import random
from itertools import combinations

import numpy as np
import pytest

from quarry.llm import graph, neardup

from .conftest import frame, prose


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[j:j + 5]) for j in range(len(w) - 4)])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return sorted((-1 if i is None else i, len(shingles(t)), -1 if i is None else find(i),
                   i is None or find(i) == i) for i, t in rows)


def edited(rng, t, share):
    return " ".join("zq" + chr(97 + rng.randrange(26)) * 3 if rng.random() < share else w for w in t.split())


def run(spark, rows, **options):
    got = neardup.near_duplicates(frame(spark, rows).repartition(4), **options).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept)
                  for r in got)


def test_equals_brute_force(spark, odd_rows):
    rng = random.Random(12)
    rows, line = [], prose(rng, 25)
    for g in range(12):  # groups around the limit, short and long
        t = prose(rng, rng.choice([5, 8, 30, 190, 250, 270, 600]), 5000)
        for _ in range(rng.randrange(1, 9)):
            rows.append((100 + len(rows), edited(rng, t, rng.choice([0, 0.005, 0.02, 0.03, 0.05]))))
    for _ in range(25):  # a line that many share
        rows.append((100 + len(rows), line + "\n" + prose(rng, rng.choice([6, 20, 60]), 5000)))
    rows += odd_rows
    assert run(spark, rows, shard_values=3000) == brute(rows)


def test_a_large_group_with_outsiders(spark):
    rng = random.Random(5)
    t = prose(rng, 120, 5000)
    rows = [(i, edited(rng, t, rng.choice([0, 0.01, 0.02, 0.04, 0.08]))) for i in range(250)]
    rows += [(1000 + i, t) for i in range(100)]
    assert run(spark, rows) == brute(rows)


def test_chains_without_a_common_centre(spark):
    """Neighbours are links, ends are not: no pivot links them all."""
    rng = random.Random(2)
    words = [f"w{i}q" for i in range(400)]
    rows = [(i, " ".join(words[8 * i:8 * i + 150])) for i in range(30)]
    got = run(spark, rows)
    assert got == brute(rows) and {c for _, _, c, _ in got} == {0}


@pytest.mark.parametrize("small, large", [(400, 500), (1000, 1250)])
def test_a_set_inside_a_larger_one(spark, small, large):
    """Part of the smaller sketch lies beyond the larger set's last kept hash."""
    rows = []
    for g in range(40):
        words = [f"g{g}w{i}" for i in range(large + 4)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:small + 4]))]
    got = run(spark, rows)
    assert got == brute(rows) and sum(kept for *_, kept in got) == 40


def test_empty_and_keep_one(spark, odd_rows):
    df = frame(spark, odd_rows)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    want = [i for i, _, _, k in brute(odd_rows) if k]
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(want)
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]
    assert neardup.near_duplicates(df.limit(0)).collect() == []


def test_union_sketch_counts_common_values_of_the_union():
    rng = np.random.default_rng(3)
    for _ in range(50):
        pool = np.unique(rng.integers(0, 2 ** 63, 600, dtype=np.uint64))
        x, y = (np.sort(rng.choice(pool, rng.integers(1, 500), replace=False)) for _ in range(2))
        u = np.union1d(x, y)[:neardup.K]
        assert neardup._union_sketch(x[:neardup.K], y[:neardup.K]) == len(set(u) & set(x) & set(y))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_a_family_just_under_the_limit_is_not_compared(spark, monkeypatch):
    """Texts of one template, each pair just short of a link: their members
    leave the lists before the join, so the work is linear in their number."""
    rng = random.Random(9)
    met = []
    real = neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, *a: met.append(pairs.count()) or real(pairs, *a))
    for size in (100, 200):
        common = [f"t{i}c" for i in range(100)]
        rows = []
        for i in range(size):
            own = [f"o{i}n{j}w" for j in range(16)]
            rows.append((i, " ".join(common[:50] + own + common[50:])))
        rows += [(1000, rows[3][1] + " end"), (1001, rows[5][1])]
        got = run(spark, rows)
        assert got == brute(rows)
        assert sum(met[-2:]) <= 2 * size
    rng.shuffle(met)


def test_an_id_with_several_texts_links_them_all(spark):
    rng = random.Random(3)
    texts = [prose(rng, 30, 5000) for _ in range(4)]
    rows = [(10, texts[0]), (50, texts[0]), (50, texts[1]), (50, texts[2]), (20, texts[2]), (30, texts[1]), (40, texts[3])]
    got = {(i, c) for i, _, c, _ in run(spark, rows)}
    assert got == {(10, 10), (50, 10), (20, 10), (30, 10), (40, 40)}


def test_a_hot_class_is_joined_apart(spark):
    """More equal texts, and more empty ones, than a key may have in the join."""
    rng = random.Random(4)
    t = prose(rng, 40, 5000)
    rows = [(5000 + i, t) for i in range(1200)] + [(i, "") for i in range(1200)] + [(9000, edited(rng, t, 0.02))]
    got = {i: c for i, _, c, _ in run(spark, rows)}
    assert {got[5000 + i] for i in range(1200)} == {5000} and got[9000] == 5000 and all(got[i] == i for i in range(1200))
