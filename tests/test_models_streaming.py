"""Invariants of trained models (rows-only operators), the streaming search
and the driver entry contract."""

import json
import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from quarry.operators import models as MD
from quarry.plans import corpus as P
from quarry.session import scratch_path
from quarry.sources import qa_model as M

from .conftest import SF_SMALL


def labelled(spark):
    d = M.table(spark, SF_SMALL, "documents")
    return M.table(spark, SF_SMALL, "labels").join(d, "doc_id").select(
        F.col("doc_id").alias("id"), "text", (1 - F.col("quality")).cast("double").alias("label"))


def test_classifier_predicts_every_row(spark):
    model = MD.train_post_classifier(labelled(spark))
    docs = M.table(spark, SF_SMALL, "documents").select(F.col("doc_id").alias("id"), "text")
    p = MD.predict_noise(model, docs)
    assert p.count() == docs.count()
    assert {r["pred"] for r in p.select("pred").distinct().collect()} <= {0, 1}


def test_stratified_folds_balance_labels(spark):
    f = MD.stratified_folds(labelled(spark), k=3)
    per = f.groupBy("fold", "label").count().collect()
    counts = {}
    for r in per:
        counts.setdefault(r["label"], []).append(r["count"])
    for v in counts.values():
        assert max(v) - min(v) <= 1


def test_kmeans_pca_shapes(spark):
    e = M.table(spark, SF_SMALL, "embeddings")
    a = MD.kmeans_assign(e, 5, "vec_id", "embedding")
    assert a.count() == e.count() and a.agg(F.max("cluster")).first()[0] <= 4
    p = MD.pca_project(e, 4, "vec_id", "embedding")
    assert p.select(F.size("projection")).distinct().first()[0] == 4


def test_encode_and_pad_lengths(spark):
    d = M.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    dic = MD.build_token_dictionary(d)
    enc = MD.encode_and_pad(d, dic, "doc_id", max_len=50)
    assert enc.count() == d.count()
    assert enc.select(F.size("ids")).distinct().first()[0] == 50


def test_cooccurrence_symmetric(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "a"])], "id long, tokens array<string>")
    x = {(r["a"], r["b"]): r["x"] for r in MD.cooccurrence_counts(df, "tokens", 2).collect()}
    assert x[("a", "b")] == x[("b", "a")] == 1.0 + 0.5  # (a0,b1) d=1 ; (b1,a3) d=2
    assert x[("a", "c")] == 0.5 + 1.0


def test_streaming_search_answers_each_query_once(spark, tmp_path):
    from quarry.streaming.search_stream import start_search_stream
    q = M.questions(spark, SF_SMALL)
    cfg = P.IndexConfig(out_dir=scratch_path(spark, "idx"), conditions=())
    paths = P.build_index(q.withColumn("snippet_count", F.lit(1)).withColumn(
        "best", F.lit(None).cast("struct<answer_id:bigint,score:int,code:array<string>>")), cfg)
    assert "postings" in paths
    qdir = tmp_path / "queries"
    qdir.mkdir()
    rows = M.search_queries(spark, SF_SMALL).limit(5).collect()
    with open(qdir / "batch1.json", "w") as fh:
        for r in rows:
            fh.write(json.dumps({"query_id": r["query_id"], "text": r["text"]}) + "\n")
    out = str(tmp_path / "out")
    ckpt = str(tmp_path / "progress")
    sq = start_search_stream(spark, str(qdir), cfg.out_dir, out, ckpt, k=3, trigger_once=True)
    sq.awaitTermination(120)
    res = spark.read.parquet(out)
    first = res.collect()
    # a restart goes on after the files already answered
    with open(qdir / "batch2.json", "w") as fh:
        fh.write(json.dumps({"query_id": 10_000, "text": rows[0]["text"]}) + "\n")
    sq = start_search_stream(spark, str(qdir), cfg.out_dir, out, ckpt, k=3, trigger_once=True)
    sq.awaitTermination(120)
    again = spark.read.parquet(out).collect()
    assert len([r for r in again if r["query_id"] != 10_000]) == len(first)
    assert any(r["query_id"] == 10_000 for r in again)
    assert res.select("query_id").distinct().count() == len(rows)
    assert res.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 3


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "rank", "post_id", "sim", "title"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_glove_factorize_vectors(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "a", "b"]), (2, ["b", "c", "d"])],
                               "id long, tokens array<string>")
    v = MD.glove_factorize(MD.cooccurrence_counts(df, "tokens", 2), rank=3, max_iter=3)
    rows = v.collect()
    assert {r["token"] for r in rows} == {"a", "b", "c", "d"}
    assert all(len(r["vector"]) == 3 for r in rows)


def test_dump_reader_rejects_bad_ids(spark, tmp_path):
    from quarry.sources import dump
    xml = ('<posts><row Id="1" PostTypeId="1" Score="5" Title="ok" CreationDate="2009-03-05T22:28:34.823"/>'
           '<row Id="x2" PostTypeId="1" Score="3" Title="bad id"/>'
           '<row Id="3" PostTypeId="2" Score="oops" Body="score does not cast"/></posts>')
    p = tmp_path / "Posts.xml"
    p.write_text(xml)
    good, bad = dump.read_dump_table(spark, str(p), "Posts", with_rejects=True)
    g = {r["Id"]: r for r in good.collect()}
    assert set(g) == {1, 3} and g[3]["Score"] is None and g[1]["CreationDate"] is not None
    assert [r["Id"] for r in bad.collect()] == ["x2"]


def test_bucketed_postings_are_pruned(spark):
    """Postings written by term bucket: the scan carries a partition filter on
    the bucket, and the results equal the search over the in-memory index."""
    import re
    from quarry.operators import sparse as SP
    from quarry.plans import search
    from quarry.sources import dump
    idf, postings = search.build_sparse_index(M.questions(spark, SF_SMALL))
    path = scratch_path(spark, "postings")
    dump.write_table(postings, path, bucket_col="term", buckets=16)
    stored = spark.read.parquet(path)
    qv = search.sparse_query_vectors(idf, M.search_queries(spark, SF_SMALL))
    got = SP.knn_join_sparse(qv, stored, 5, term_buckets=16)
    plan = got._jdf.queryExecution().executedPlan().toString()
    scans = [ln for ln in plan.split("\n") if "FileScan parquet" in ln and "postings" in ln]
    assert scans and all(re.search(r"PartitionFilters: \[_bucket#\d+ IN", s_) for s_ in scans)
    want = SP.knn_join_sparse(qv, postings, 5)
    cols = ["query_id", "post_id", "sim", "rank"]
    assert {tuple(r) for r in got.select(*cols).collect()} == {tuple(r) for r in want.select(*cols).collect()}


def test_spread_only_when_scan_is_narrow(spark):
    from quarry.plans.strategy import spread
    one = spark.range(0, 1000, numPartitions=1)
    assert spread(one, 4).rdd.getNumPartitions() == 4
    many = spark.range(0, 1000, numPartitions=8)
    assert spread(many, 4).rdd.getNumPartitions() == 8


def test_write_table_hash_buckets(spark):
    from quarry.sources import dump
    df = spark.range(0, 200).selectExpr("id AS post_id", "cast(id % 7 AS string) AS term")
    path = scratch_path(spark, "bucketed")
    dump.write_table(df, path, bucket_col="term", buckets=4)
    back = dump.read_table(spark, path)
    assert back.count() == 200
    chk = back.withColumn("b", F.pmod(F.xxhash64("term"), F.lit(4)).cast("int"))
    assert chk.filter(F.col("b") != F.col("_bucket")).count() == 0


def test_training_words_are_those_of_a_count_vectorizer(spark, monkeypatch):
    from pyspark.ml.feature import CountVectorizer
    from quarry.operators import models as MD
    rows = [(i, float(i % 2), f"w{i % 3} w{i % 3} w{i % 5} " + " ".join(f"v{j}" for j in range(i % 7))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label double, text string")
    data = MD.materialize(MD.stratified_folds(MD.with_tokens(df), 3))
    got = MD.training_words(data, 3, 100)
    for fold in range(3):
        rest = data.filter(F.col("fold") != fold)
        assert set(got[fold]) == set(CountVectorizer(inputCol="tokens", outputCol="f", minDF=1.0).fit(rest).vocabulary)
        n = {r.t: r["count"] for r in rest.select(F.explode("tokens").alias("t")).groupBy("t").count().collect()}
        assert got[fold] == sorted(n, key=lambda w: (-n[w], w))
    assert MD.training_words(data, 3, 2) == [w[:2] for w in got]
    # no model counts the words again
    monkeypatch.setattr(CountVectorizer, "fit", None)
    pred = MD.out_of_fold(df, MD.grid(reg=[0.01], vocab_size=[5, 50], max_iter=[3]), 3)
    assert sorted((r.setting, r.id) for r in pred.collect()) == [(s, i) for s in range(2) for i in range(60)]
