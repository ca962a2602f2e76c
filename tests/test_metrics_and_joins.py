"""Metrics on hand-made label lists; dense block joins vs brute force; BIO
merging; greedy link pairs; global rank."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import dense as D
from quarry.operators import entities as EN
from quarry.operators import evaluation as E
from quarry.plans.strategy import global_rank


def labels_df(spark, lists):
    rows = [(q, r + 1, int(v)) for q, l in enumerate(lists) for r, v in enumerate(l)]
    return spark.createDataFrame(rows, "query_id long, rank int, rel int")


def test_average_precision_and_map(spark):
    # AP@5 of [1,0,1,0,0] = (1/1 + 2/3) / 5 ; of [0,0,0,0,1] = (1/5) / 5
    lab = labels_df(spark, [[1, 0, 1, 0, 0], [0, 0, 0, 0, 1]])
    ap = {r["query_id"]: r["ap"] for r in E.average_precision(lab, ks=(5,)).collect()}
    assert ap[0] == pytest.approx((1 + 2 / 3) / 5)
    assert ap[1] == pytest.approx(0.2 / 5)
    m = E.mean_average_precision(E.average_precision(lab, ks=(5,))).first()["map"]
    assert m == pytest.approx(((1 + 2 / 3) / 5 + 0.04) / 2)


def test_search_length(spark):
    lab = labels_df(spark, [[0, 1, 0, 1], [0, 0, 0, 0]])
    sl = {(r["query_id"], r["n"]): r["search_length"]
          for r in E.search_length(lab, ns=(1, 2, 3), max_results=20).collect()}
    assert sl[(0, 1)] == 1 and sl[(0, 2)] == 2 and sl[(0, 3)] == 20 and sl[(1, 1)] == 20


def brute_topk(Q, D_, k, qids, pids, exclude_self):
    qn = Q / np.linalg.norm(Q, axis=1, keepdims=True)
    dn = D_ / np.linalg.norm(D_, axis=1, keepdims=True)
    S = np.round(qn @ dn.T, 6)
    out = set()
    for i, q in enumerate(qids):
        cand = [(-S[i, j], p) for j, p in enumerate(pids) if not (exclude_self and p == q)]
        for s, p in sorted(cand)[:k]:
            out.add((int(q), int(p), round(-s, 6)))
    return out


@pytest.mark.parametrize("block_rows,broadcast_bytes", [(7, 0), (50, 0), (1000, 0), (2048, 64 << 20)])
def test_knn_block_join_is_exact(spark, block_rows, broadcast_bytes):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(120, 6))
    rows = [(i, "f", [float(v) for v in X[i]]) for i in range(120)]
    idx = spark.createDataFrame(rows, "post_id long, field string, vector array<double>")
    res = D.knn_join_dense(idx.withColumnRenamed("post_id", "query_id"), idx, 5, ["f"],
                           exclude_self=True, block_rows=block_rows, broadcast_bytes=broadcast_bytes)
    got = {(r["query_id"], r["post_id"], round(r["sim"], 6)) for r in res.collect()}
    assert got == brute_topk(X, X, 5, list(range(120)), list(range(120)), True)


@pytest.mark.parametrize("broadcast_bytes", [0, 64 << 20])
def test_threshold_join_is_exact(spark, broadcast_bytes):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(60, 4))
    rows = [(i, "f", [float(v) for v in X[i]]) for i in range(60)]
    idx = spark.createDataFrame(rows, "post_id long, field string, vector array<double>")
    res = D.threshold_join(idx.withColumnRenamed("post_id", "query_id"), idx, 0.5, ["f"], block_rows=16,
                           broadcast_bytes=broadcast_bytes)
    got = {(r["query_id"], r["post_id"]) for r in res.collect()}
    xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = np.round(xn @ xn.T, 6)
    want = {(i, j) for i in range(60) for j in range(60) if i != j and S[i, j] > 0.5}
    assert got == want


def test_merge_bio_spans_standard_and_legacy(spark):
    tags = ["B-api", "I-api", "O", "I-api", "B-pl", "I-api"]
    toks = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame([(1, i, t, g) for i, (t, g) in enumerate(zip(toks, tags))],
                               "sid long, pos int, token string, tag string")
    std = [r["entity"] for r in EN.merge_bio_spans(df, ["sid"]).orderBy("span").collect()]
    assert std == ["api##a b", "api##d", "pl##e", "api##f"]
    leg = [r["entity"] for r in EN.merge_bio_spans(df, ["sid"], legacy_gap=True).orderBy("span").collect()]
    # as coded originally: an I-x continues the last entity of type x across O,
    # the span id restarts only on a new start
    assert leg == ["api##a b d", "pl##e", "api##f"]


def test_greedy_linked_pairs(spark):
    res = spark.createDataFrame([(0, i) for i in (1, 2, 3, 4)], "query_id long, post_id long")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4)], "src_id long, dst_id long")
    got = sorted((r["src_id"], r["dst_id"]) for r in E.greedy_linked_pairs(res, links).collect())
    # (1,2) kept; (1,4): 1 already a source -> skipped; (2,3): 2 seen as target -> skipped;
    # (3,4): 3 unseen -> kept
    assert got == [(1, 2), (3, 4)]


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    r = global_rank(df, [F.col("v").desc()], "rk").collect()
    assert sorted(x["rk"] for x in r) == list(range(1, 1001))
    assert all(x["rk"] == 1000 - x["v"] for x in r)


def test_lookup_vectors_unk_and_skip(spark):
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("<unk>", [0.0, 1.0])], "token string, vector array<double>")
    toks = spark.createDataFrame([(1, "a"), (1, "zz")], "id long, token string")
    unk = {r["token"]: list(r["vector"]) for r in D.lookup_vectors(toks, vecs, oov="unk").collect()}
    assert unk == {"a": [1.0, 0.0], "zz": [0.0, 1.0]}
    skip = [r["token"] for r in D.lookup_vectors(toks, vecs, oov="skip").collect()]
    assert skip == ["a"]
    plan = D.lookup_vectors(toks, vecs, oov="unk")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("model", ["sparse", "dense", "hybrid"])
def test_search_with_tags_equals_filter_of_full_ranking(spark, model):
    """Tag-filtered top-k == top-k of the unfiltered full scoring restricted to
    allowed posts (brute force), for every model; unknown-only tags -> empty."""
    from quarry.catalog.q_relational import _meta
    from quarry.operators import sparse as SP
    from quarry.plans import search
    from quarry.sources import qa_model as M
    from .conftest import SF_SMALL
    q = M.questions(spark, SF_SMALL)
    wv = M.word_vectors(spark, SF_SMALL)
    meta = _meta(spark, SF_SMALL)
    base = M.search_queries(spark, SF_SMALL)
    tags = (F.when(F.col("query_id") % 7 == 0, F.array(F.lit("no-such-tag")))
            .when(F.col("query_id") % 3 == 0, F.array().cast("array<string>"))
            .when(F.col("query_id") % 2 == 0, F.array(F.lit("en")))
            .otherwise(F.array(F.lit("src3"), F.lit("fr"))))
    queries = base.withColumn("tags", tags)
    got, top = search.search(q, queries, meta, model=model, k=5, word_vectors=wv)
    got_set = {(r["query_id"], r["post_id"], r["rank"]) for r in got.collect()}
    # brute force: all scores of the model, filter, rank
    idf, postings = search.build_sparse_index(q)
    qs = search.sparse_query_vectors(idf, base)
    idx = search.build_dense_index(q, wv)
    qd = search.dense_query_vectors(base, wv)
    if model == "sparse":
        allp = SP.knn_join_sparse(qs, postings, None)
    elif model == "dense":
        qv = D.field_concat(qd.withColumnRenamed("query_id", "qid"), "qid", search.FIELDS)
        iv = D.field_concat(idx.withColumnRenamed("post_id", "pid"), "pid", search.FIELDS)
        allp = D.block_pairs_join(qv, iv, threshold=float("-inf")).select(
            F.col("qid").alias("query_id"), F.col("pid").alias("post_id"), "sim")
    else:
        allp = search.hybrid_scores(qd, idx, qs, postings, 10 ** 6, ranked=False)
    want = SP.rank_results(search.tag_filter(allp, queries, meta), 5)
    want_set = {(r["query_id"], r["post_id"], r["rank"]) for r in want.collect()}
    assert got_set == want_set
    assert not [r for r in got.collect() if r["query_id"] % 7 == 0]
    assert top.count() > 0


def test_term_neighbours_equal_all_pairs(spark):
    """The k best posts of every source and field set, sparse and hybrid, over
    many blocks, equal those of all pairs; no pair is shuffled."""
    from quarry.plans import evaluate as EV
    rng = np.random.default_rng(3)
    sets = [["title"], ["body"], ["title", "body"]]
    rows, vecs = {}, {}
    for i in range(60):
        if i != 7:  # a post without a vector
            vecs[i] = rng.standard_normal(6)
        for f in ("title", "body"):
            same = i - i % 3 if i >= 45 else i   # groups of equal posts
            g = np.random.default_rng(same * 2 + (f == "body"))
            terms = [] if i == 9 and f == "title" else sorted(set(g.integers(0, 40, 5).tolist()))
            w = g.random(len(terms)) + 0.1
            for t, x in zip(terms, w / np.linalg.norm(w) if len(w) else []):
                rows[i, f, f"t{t}"] = float(x)
    postings = spark.createDataFrame([(i, f, t, w) for (i, f, t), w in rows.items()] + [(None, "title", "t1", 1.0)],
                                     "post_id long, field string, term string, weight double")
    asked = [*range(0, 60, 2), 7, 9, 1000]
    sources = spark.createDataFrame([(i,) for i in asked], "source_id long")
    tables = [spark.createDataFrame([(i, (v * (n + 1)).tolist()) for i, v in vecs.items()], "pid long, vec array<double>") for n in range(3)]
    fields = ["body", "title"]
    found = EV.term_neighbours(EV.post_rows(postings, sources, fields), sources, fields, sets, 4, tables, block_bytes=4_000)
    best = {}
    for r in found.collect():
        best.setdefault((r.hybrid, r.no, r.query_id), []).append((-round(r.sim, 6), r.post_id))
    want = {}
    for no, own in enumerate(sets):
        for q in asked:
            for p in range(60):
                s = sum(w * rows.get((p, f, t), 0.0) for (i, f, t), w in rows.items() if i == q and f in own)
                if s > 0 and p != q:
                    d = float(vecs[q] @ vecs[p]) * (no + 1) ** 2 if q in vecs and p in vecs else 0.0
                    want.setdefault((False, no, q), []).append((-round(s, 6), p))
                    want.setdefault((True, no, q), []).append((-round(s + d, 6), p))
    cut = lambda d: {key: [p for _, p in sorted(v)[:4]] for key, v in d.items()}
    assert cut(best) == cut(want) and len(want) > 150
    # a few rows per source and block leave the tasks, not a row per pair
    blocks = EV.block_count(60, 4_000 // (16 * 9 + 8 * 18))
    assert max(len(v) for v in best.values()) <= 4 * blocks


def test_dots_in_pieces(monkeypatch):
    import pandas as pd

    from quarry.plans import evaluate as EV
    monkeypatch.setattr(EV, "MATCHES", 7)
    rng = np.random.default_rng(4)
    # terms 0 to 11 of two fields: the remainder is the field
    q, p = (np.where(rng.random((n, 12)) < 0.5, rng.random((n, 12)), 0.0) for n in (5, 9))
    q[2] = 0
    entries = lambda m: pd.DataFrame({"terms": [np.flatnonzero(r) for r in m], "weights": [r[r > 0] for r in m]})
    who, t = np.nonzero(p)
    order = np.argsort(t, kind="stable")
    got = EV._dots(entries(q), slice(1, 4), (t[order], p[who, t][order], who[order]), 9, 2)
    want = np.stack([q[1:4, f::2] @ p[:, f::2].T for f in (0, 1)])
    assert np.abs(got - want).max() < 1e-12
