"""Threshold joins, bucket joins, block-max postings, cell index, split tables
and the completion of results, against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import blockmax, buckets, cells
from quarry.operators import dense as D
from quarry.operators import sparse as SP
from quarry.session import scratch_path
from quarry.sources import dump

POSTINGS = "post_id long, field string, term string, weight double"


def unit_postings(seed, posts=120, vocab=60, fields=("title", "body")):
    """Postings of unit length per post and field; few terms are frequent,
    some posts are near copies of others."""
    rng = random.Random(seed)
    docs = {}
    for p in range(posts):
        for f in fields:
            if p > 20 and rng.random() < 0.3:
                v = dict(docs[rng.randrange(20), f])
                v[f"t{rng.randrange(vocab)}"] = rng.random()
            else:
                v = {f"t{int(vocab * rng.random() ** 2.5)}": rng.random() + 0.1 for _ in range(rng.randrange(0, 9))}
            n = math.sqrt(sum(x * x for x in v.values()))
            docs[p, f] = {t: x / n for t, x in v.items()}
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(p, f, t, w) for (p, f), v in docs.items() for t, w in v.items()], POSTINGS)


def dots(docs, fields, scale):
    ids = sorted({p for p, _ in docs})
    out = {}
    for a in ids:
        for b in ids:
            if a != b:
                out[a, b] = sum(scale * w * docs[b, f].get(t, 0.0) for f in fields for t, w in docs[a, f].items())
    return out


@pytest.mark.parametrize("t,fields,mean", [(0.3, ["title", "body"], True), (0.7, ["body"], True), (0.95, ["title"], True),
                                           (0.9, ["title", "body"], False), (0.02, ["title", "body"], True)])
def test_sparse_threshold_join_equals_brute_force(spark, t, fields, mean):
    docs = unit_postings(int(t * 100))
    got = {(r.query_id, r.post_id): r.sim for r in SP.threshold_join_sparse(frame(spark, docs), t, fields, mean).collect()}
    score = dots(docs, fields, 1 / len(fields) if mean else 1.0)
    clear = {k: s for k, s in score.items() if s > t + 1e-6}
    assert set(clear) <= set(got) and all(score[k] > t - 1e-6 and abs(score[k] - s) < 2e-6 for k, s in got.items())
    assert len(got) > 20


def test_frequent_terms_are_left_out_of_the_lists(spark):
    """A term that all posts share, and that no pair needs, has no list."""
    docs = {}
    for p in range(200):
        v = {"the": 0.3, f"own{p}": 0.8, f"pair{p // 2}": 0.52}
        n = math.sqrt(sum(x * x for x in v.values()))
        docs[p, "body"] = {t: x / n for t, x in v.items()}
    postings = frame(spark, docs)
    x = SP.indexed_part(SP._stacked(postings, ["body"], {"body": 1.0}, "post_id"), 0.33)
    assert {r.term[:4] for r in x.select("term").distinct().collect()} == {"pair"}
    got = {(r.query_id, r.post_id) for r in SP.threshold_join_sparse(postings, 0.33, ["body"]).collect()}
    assert got == {(p, p ^ 1) for p in range(200)}
    with pytest.raises(ValueError):
        SP.threshold_join_sparse(postings, 0.0)


@pytest.mark.parametrize("block_posts", [16, 40])
def test_sparse_threshold_join_in_many_blocks(spark, block_posts, monkeypatch):
    """Pairs within a block and across blocks, each once per direction; also of
    terms that are added up one by one, a few matches at a time."""
    docs = unit_postings(11)
    want = {k for k, s in dots(docs, ["title", "body"], 0.5).items() if s > 0.3 + 1e-6}
    got = [(r.query_id, r.post_id) for r in SP.threshold_join_sparse(frame(spark, docs), 0.3, block_posts=block_posts).collect()]
    assert len(got) == len(set(got)) and want <= set(got)


def test_sparse_threshold_join_shuffles_no_pairs(spark):
    """No table is joined with itself: pairs that share a term exist in numpy only."""
    plan = SP.threshold_join_sparse(frame(spark, unit_postings(12)), 0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInPandas" in plan


@pytest.mark.parametrize("share,matches", [(0.0, 1 << 20), (2.0, 1 << 20), (0.05, 7)])
def test_block_scores_are_dot_products(monkeypatch, share, matches):
    """By matrices, by entries and by both, with an entry that stands twice."""
    monkeypatch.setattr(SP, "DENSE_SHARE", share)
    monkeypatch.setattr(SP, "MATCHES", matches)
    monkeypatch.setattr(SP, "COLUMNS", 3)
    rng = np.random.default_rng(5)

    def block(n):
        terms = [np.sort((40 * rng.random(rng.integers(0, 12)) ** 2).astype(np.int64)) for _ in range(n)]
        terms[0] = np.array([1, 1, 3])
        posts = pd.DataFrame({"terms": terms, "weights": [rng.random(len(t)) for t in terms]})
        full = np.zeros((n, 40))
        for i, (t, w) in enumerate(zip(posts["terms"], posts["weights"])):
            np.add.at(full[i], t, w)
        return SP._entries(posts, slice(None)), full

    (a, x), (b, y) = block(30), block(21)
    assert np.allclose(SP.block_scores(a, 30, b, 21), x @ y.T)


def vectors(seed, n, dim=12, clusters=20):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((clusters, dim))
    return [(i, (centre[rng.integers(clusters)] + rng.standard_normal(dim) * 0.25).tolist()) for i in range(n)]


def test_bucket_join_is_a_subset_of_high_recall(spark):
    rows = vectors(1, 400)
    ix = spark.createDataFrame([(i, "f", v) for i, v in rows], "post_id long, field string, vector array<double>")
    q = ix.withColumnRenamed("post_id", "query_id")
    how = buckets.Buckets(bits=8, tables=30, seed=3)
    exact = {(r.query_id, r.post_id): r.sim for r in D.threshold_join(q, ix, 0.85, ["f"]).collect()}
    near = {(r.query_id, r.post_id): r.sim for r in D.threshold_join(q, ix, 0.85, ["f"], approximate=how).collect()}
    assert set(near) <= set(exact) and all(abs(exact[k] - near[k]) < 1e-5 for k in near)
    assert len(near) >= 0.9 * len(exact) > 100 and how.expected_recall(0.85) > 0.9
    top = lambda how: {(r.query_id, r.post_id) for r in D.knn_join_dense(
        q, ix, 5, ["f"], exclude_self=True, approximate=how).collect()}
    assert len(top(how) & top(None)) >= 0.9 * len(top(None))
    with pytest.raises(ValueError):
        buckets.Buckets(bits=0)


@pytest.mark.parametrize("k,exclude", [(1, False), (7, True), (500, False)])
def test_cell_search_equals_a_full_scan(spark, k, exclude):
    rows = vectors(2, 300) + [(1000, [0.0] * 12), (1001, [9.0] * 12)] + [(1002 + i, [0.5] * 12) for i in range(30)]
    iv = spark.createDataFrame(rows, "pid long, vec array<double>")
    qv = spark.createDataFrame(vectors(2, 40) + [(5000, [0.0] * 12), (5001, [-3.0] + [0.0] * 11)], "qid long, vec array<double>")
    path = scratch_path(spark, "cells")
    cells.write_cells(iv, path)
    top, report = cells.search_cells(spark, path, qv, k, exclude_self=exclude, report=True)
    keys = ["qid", "pid", "sim", "rank"]
    want = Counter(tuple(r) for r in D.knn_join_vectors(qv, iv, k, exclude_self=exclude).select(*keys).collect())
    assert Counter(tuple(r) for r in top.select(*keys).collect()) == want
    read = report.collect()
    assert len(read) == 42 and all(r.rows == len(rows) and r.cells_read <= r.cells for r in read)
    if k == 1:   # clustered vectors: most cells are skipped
        assert sum(r.rows_read for r in read) < 0.6 * sum(r.rows for r in read)


@pytest.mark.parametrize("weights,k", [(None, 3), ({"title": 0.2, "body": 0.8}, 10), (None, 500)])
def test_block_max_search_equals_the_plain_join(spark, weights, k):
    docs = unit_postings(9, posts=400)
    postings = frame(spark, docs)
    rng = random.Random(4)
    q = []
    for i in range(15):
        q += [(i, f"t{t}", rng.random()) for t in rng.sample(range(60), rng.randrange(1, 6))]
    q += [(99, "absent", 1.0)]
    queries = spark.createDataFrame(q, "query_id long, term string, weight double")
    path = scratch_path(spark, "blockmax")
    blockmax.write_postings(frame(spark, docs), path, 400, rows_per_bucket=150, block_posts=8)
    stored, maxima = blockmax.read_postings(spark, path, queries)
    top, report = blockmax.search_blocks(queries, stored, maxima, k, weights, report=True)
    keys = ["query_id", "post_id", "sim", "rank"]
    want = Counter(tuple(r) for r in SP.knn_join_sparse(queries, postings, k, weights=weights).select(*keys).collect())
    assert Counter(tuple(r) for r in top.select(*keys).collect()) == want
    rows = report.collect()
    assert len(rows) == 15 and all(r.rows_read <= r.rows and r.blocks_read <= r.blocks for r in rows)
    if k == 3:
        assert sum(r.rows_read for r in rows) < sum(r.rows for r in rows)


def test_a_frequent_key_is_split_over_files(spark):
    """One key with a third of all rows: every bucket holds about as many rows
    as the others, the manifest finds them all, and only they are read."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(900)}", float(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "post_id long, term string, weight double")
    path = scratch_path(spark, "split")
    dump.write_split_table(df, path, "term", "post_id", 250)
    sizes = sorted(r["count"] for r in spark.read.parquet(f"{path}/rows").groupBy("_bucket").count().collect())
    assert sum(sizes) == 6000 and sizes[-1] <= 2 * sizes[len(sizes) // 2] and len(sizes) == 24
    for wanted in (["hot"], ["k1", "k2", "none"], []):
        keys = spark.createDataFrame([(w,) for w in wanted], "term string")
        got = dump.read_split_table(spark, path, keys)
        assert Counter(tuple(r) for r in got.select("post_id", "term", "weight").collect()) == Counter(
            r for r in rows if r[1] in wanted)
    few = dump.read_split_table(spark, path, spark.createDataFrame([("k1",)], "term string"))
    read = few._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in read.split("\n") if "FileScan parquet" in line and "/rows" in line)
    assert "PartitionFilters: [_bucket" in scan or "PartitionFilters: [isnotnull(_bucket" in scan
    dump.write_split_table(df.limit(0), scratch_path(spark, "split0"), "term", "post_id")


def test_results_are_completed_up_to_k(spark):
    posts = [(i, [["a"], ["a", "b"], []][i % 3]) for i in range(10, 40)]
    meta = spark.createDataFrame(posts, "post_id long, etags array<string>")
    scored = {1: {12: 0.5, 10: 0.9}, 2: {i: 0.1 for i in range(10, 40)}, 3: {}, 4: {13: 0.3}, 5: {}, 6: {}}
    queries = spark.createDataFrame([(1, None), (2, []), (3, []), (4, ["b"]), (5, ["b", "a"]), (6, ["none"])],
                                    "query_id long, tags array<string>")
    ranked = SP.rank_results(spark.createDataFrame([(q, p, s) for q, v in scored.items() for p, s in v.items()],
                                                   "query_id long, post_id long, sim double"), 7)
    for tags in (None, "tags"):
        got = defaultdict(list)
        for r in sorted(SP.fill_to_k(ranked, queries, meta, 7, tags_col=tags).collect(), key=lambda r: r["rank"]):
            got[r.query_id].append((r["rank"], r.post_id, r.sim))
        for q, wanted in ((r.query_id, r.tags) for r in queries.collect()):
            every = sorted(((-scored[q].get(p, 0.0), p) for p, t in posts
                            if not tags or not wanted or set(wanted) & set(t) or p in scored[q]))[:7]
            assert got[q] == [(n, p, -s) for n, (s, p) in enumerate(every, 1)]
