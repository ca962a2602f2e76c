"""Rules that results once broke unseen: literal cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import dense as D
from quarry.operators import evaluation as E
from quarry.operators import models as MD
from quarry.plans import search
from quarry.plans.strategy import materialize


def test_a_table_overwritten_in_place_is_read_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    assert materialize(spark.read.parquet(path)).count() == 5
    spark.range(9).write.mode("overwrite").parquet(path)
    assert materialize(spark.read.parquet(path)).count() == 9


def test_dense_vectors_average_all_tokens(spark):
    wv = spark.createDataFrame([("a", [2.0, 0.0]), ("the", [0.0, 3.0]), ("<unk>", [-5.0, 0.0])], "token string, vector array<double>")
    docs = spark.createDataFrame([(1, "a the"), (2, ""), (3, "a zz a a"), (4, None)], "id long, text string")
    got = {r.id: list(np.round(r.vector, 9)) for r in D.doc_vectors(docs, wv, "id", "text", None).collect()}
    assert got == {1: [0.5, 0.5], 2: [-1.0, 0.0], 3: [0.5, 0.0], 4: [-1.0, 0.0]}


def test_hit_rate_keeps_groups_without_a_hit(spark):
    s = spark.createDataFrame([("x", 1, 2), ("x", 2, 1), ("y", 1, 9)], "g string, source_id long, result_id long")
    lk = spark.createDataFrame([(1, 2), (2, 1)], "src_id long, dst_id long")
    got = {r.g: (r.hits, r.hit_pct) for r in E.link_hit_rate(s, lk, ("g",)).collect()}
    assert got == {"x": (2, 200.0), "y": (0, 0.0)}
    one = {r.g: r.hit_pct for r in E.link_hit_rate(s, lk, ("g",), undirected=True).collect()}
    assert one == {"x": 100.0, "y": 0.0}


def test_scores_stay_within_the_budget():
    parts = D.score_slices(5000, 10_000, 8 << 20)
    assert sum(p.stop - p.start for p in parts) == 5000
    assert max((p.stop - p.start) * 10_000 * 8 for p in parts) <= 8 << 20


@pytest.mark.parametrize("k", [1, 3, 10])
def test_partial_selection_breaks_ties_by_id(k):
    rng = np.random.default_rng(k)
    for _ in range(50):
        s, ids = rng.integers(0, 4, 30).astype(float), rng.permutation(30)
        s[rng.random(30) < 0.2] = -np.inf
        want = [j for j in sorted(range(30), key=lambda j: (-s[j], ids[j])) if np.isfinite(s[j])][:k]
        assert D._best(s, ids, k).tolist() == want


def test_block_path_equals_broadcast_path(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    q = spark.createDataFrame(rows, "qid long, vec array<double>")
    it = q.withColumnRenamed("qid", "pid")
    a = D.knn_join_vectors(q, it, 5, exclude_self=True)
    b = D.knn_join_vectors(q, it, 5, exclude_self=True, block_rows=32, broadcast_bytes=0)
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}


def test_weights_must_fit_the_fields(spark):
    q = spark.createDataFrame([(1, "a")], "query_id long, text string")
    with pytest.raises(ValueError):
        search.search(q, q, q, model="sparse", weights={"title": 5.0})


def test_connector_words_join_a_phrase(spark):
    docs = spark.createDataFrame([(1, ["state", "of", "art", "x"]), (2, ["state", "of", "art"]), (3, ["of", "art"]), (4, [])],
                                 "id long, tokens array<string>")
    pc = MD.phrase_counts(docs, "tokens", 2, ("of",))
    assert [(r.a, r.mid, r.b, r.n_ab) for r in pc.collect()] == [("state", "of", "art", 2)]
    out = MD.apply_phrases(docs, pc.withColumn("score", F.lit(99.0)), "id", connectors=("of",))
    got = {r.id: r.tokens for r in out.collect()}
    assert got == {1: ["state_of_art", "x"], 2: ["state_of_art"], 3: ["of", "art"], 4: []}


def test_overlapping_phrases_merge_from_the_left(spark):
    docs = spark.createDataFrame([(1, list("aaaaa"))], "id long, tokens array<string>")
    ph = spark.createDataFrame([("a", "", "a", 99.0)], "a string, mid string, b string, score double")
    assert MD.apply_phrases(docs, ph, "id").first().tokens == ["a_a", "a_a", "a"]


def test_a_one_dimensional_vector_file(spark, tmp_path):
    from quarry.sources import files
    (tmp_path / "v.vec").write_text("2 1\na 0.5\nb 0.25\n")
    got = {r.token: r.vector for r in files.read_word_vectors(spark, str(tmp_path / "v.vec")).collect()}
    assert got == {"a": [0.5], "b": [0.25]}


def test_an_existing_session_keeps_its_settings(spark):
    from quarry.session import get_spark
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert get_spark("again").conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("model", ["sparse", "dense", "hybrid"])
def test_a_stored_index_answers_like_a_fresh_one(spark, model):
    from quarry.plans import corpus as P
    from quarry.session import scratch_path
    from quarry.sources import qa_model as M
    from .conftest import SF_SMALL
    q = M.questions(spark, SF_SMALL).withColumn("snippet_count", F.lit(1)).withColumn(
        "best", F.lit(None).cast("struct<answer_id:bigint,score:int,code:array<string>>"))
    wv = M.word_vectors(spark, SF_SMALL)
    cfg = P.IndexConfig(out_dir=scratch_path(spark, "stored"), conditions=(), build_dense_index=True)
    P.build_index(q, cfg, wv)
    queries = M.search_queries(spark, SF_SMALL)
    weights = {"title": 0.3, "body": 0.7}
    meta = spark.read.parquet(f"{cfg.out_dir}/metadata")
    got, _ = search.search_stored(spark, cfg.out_dir, queries, model, 5, wv, weights)
    want, _ = search.search(q, queries, meta, model, 5, wv, weights)
    cols = ["query_id", "rank", "post_id", "sim"]
    rows = {tuple(r) for r in got.select(*cols).collect()}
    assert rows and rows == {tuple(r) for r in want.select(*cols).collect()}
    plain, _ = search.search(q, queries, meta, model, 5, wv)
    assert rows != {tuple(r) for r in plain.select(*cols).collect()}


def test_a_second_pass_forms_phrases_of_three_words(spark):
    docs = spark.createDataFrame([(i, ["new", "york", "city", f"w{i}"]) for i in range(6)]
                                 + [(10 + i, ["city", f"x{i}", "new", f"y{i}"]) for i in range(3)] + [(20, [])],
                                 "id long, tokens array<string>")
    for passes, want in ((1, ["new_york", "city", "w0"]), (2, ["new_york_city", "w0"])):
        got = {r.id: r.tokens for r in MD.merge_phrases(docs, "id", min_count=2, threshold=0.5, passes=passes).collect()}
        assert len(got) == 10 and got[0] == want and got[10] == ["city", "x0", "new", "y0"] and got[20] == []
