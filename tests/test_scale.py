"""What the joins of the search engine move: the frequent part of a large
vocabulary is broadcast, vectors meet in blocks, sums stay in hash aggregates.
Results against plain versions."""

import contextlib
import io
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import buckets
from quarry.operators import dense as D
from quarry.operators import entities as EN
from quarry.operators import models as MD
from quarry.operators import sparse as SP
from quarry.plans import search, strategy


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def texts(seed, n=60, vocab=40):
    rng = random.Random(seed)
    word = lambda: f"w{int(vocab * rng.random() ** 2)}"
    return [(i, " ".join(word() for _ in range(rng.randrange(0, 30)))) for i in range(n)] + [(3, "w1 w2 w39"), (None, "w1 w5 w39")]


def test_tasks_of_term_counts_follow_the_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "abc " * 1000) for i in range(40)], "id long, text string")
    monkeypatch.setattr(SP, "TASK_TEXT_BYTES", 16_000)
    assert SP.text_tasks(docs, "text") == 10
    assert SP.term_counts(docs, "id", "text").rdd.getNumPartitions() == 10


def test_postings_of_a_split_vocabulary(spark):
    """A vocabulary beyond the broadcast bound gives the same postings, and only
    rows of rare terms are shuffled by term."""
    docs = spark.createDataFrame(texts(1), "id long, text string")
    idf = SP.tfidf_fit(docs, "id", "text", stop=False)
    tf = SP.term_counts(docs, "id", "text", stop=False, tasks=3)
    split = SP.postings_from_counts(tf, idf, ["id"], max_broadcast_terms=7, tasks=3)
    whole = SP.postings_from_counts(tf, idf, ["id"])
    rows = lambda df: sorted((str(r.id), r.term, round(r.weight, 9)) for r in df.collect())
    assert rows(split) == rows(whole) and len(rows(whole)) > 300
    # the window that sums the norms follows the union without an exchange
    p = plan(split)
    assert "Exchange" not in p[p.index("Window"):p.index("Union")]


def test_lookup_of_a_split_table(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, None if i % 50 == 0 else f"k{int(30 * rng.random() ** 3)}") for i in range(600)], "i int, key string")
    keyed = spark.createDataFrame([(f"k{j}", j) for j in range(2, 40)] + [("k5", 500)], "key string, v int")
    want = sorted(map(str, rows.join(keyed, "key", "left").select("i", "key", "v").collect()))
    for bound in (1, 6, 10_000):
        assert sorted(map(str, strategy.lookup(rows, keyed, "key", bound).select("i", "key", "v").collect())) == want


def test_document_vectors_are_hash_aggregates(spark):
    docs = spark.createDataFrame([(0, "a b b"), (1, ""), (2, None), (3, "zz a")], "id long, text string")
    wv = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 2.0]), ("<unk>", [5.0, 0.0])], "token string, vector array<double>")
    v = D.doc_vectors(docs, wv, "id", "text", None)
    assert "ObjectHashAggregate" not in plan(v) and "SortAggregate" not in plan(v)
    got = {r.id: np.round(r.vector, 9).tolist() for r in v.collect()}
    assert got == {0: [0.2, round(2.8 / 3, 9)], 1: [1.0, 0.0], 2: [1.0, 0.0], 3: [0.8, 0.4]}


@pytest.mark.parametrize("k", [1, 4, 60])
def test_best_scores_of_many_batches(k):
    """Ties by id, masked and non-finite scores, a row's own id."""
    rng = np.random.default_rng(k)
    Q, X = rng.integers(-2, 3, (30, 5)).astype(float), rng.integers(-2, 3, (50, 5)).astype(float)
    X[7, 2] = np.nan
    ids = rng.permutation(50)
    sc = D._Scorer(np.arange(30), Q, None, k, None, True, 6)
    for at in range(0, 50, 13):
        assert not list(sc.add(ids[at:at + 13], X[at:at + 13], None))
    got = defaultdict(list)
    for q, p, s in sc.result().itertuples(index=False):
        got[q].append((p, s))
    for q in range(30):
        pairs = [(int(ids[j]), float(Q[q] @ X[j])) for j in range(50) if ids[j] != q and np.isfinite(Q[q] @ X[j])]
        assert got[q] == sorted(pairs, key=lambda x: (-x[1], x[0]))[:k]


def test_shuffled_blocks_are_large():
    """Small blocks would be copied once per block of the other side."""
    assert D.shuffled_block_rows(64, 20, 128) >= 10_000
    rows = D.shuffled_block_rows(64, None, 128)
    assert 1000 < rows and rows * rows * 8 <= D.BLOCK_BYTES


def test_buckets_return_only_pairs_of_the_result(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((6, 8))
    rows = [(i, (centre[i % 6] + rng.standard_normal(8) * 0.1).tolist()) for i in range(90)]
    q, it = (spark.createDataFrame(rows, f"{c} long, vec array<double>") for c in ("qid", "pid"))
    how = buckets.Buckets(bits=4, tables=6, seed=1)
    x = np.array([v for _, v in rows])
    dots = np.round(x @ x.T, 6)
    found = {(r.qid, r.pid): r.sim for r in buckets.scored_candidates(q, it, how, True, threshold=5.0).collect()}
    assert found and all(s > 5.0 and abs(s - dots[a, b]) < 2e-6 and a != b for (a, b), s in found.items())
    near = {(a, b) for a in range(90) for b in range(a % 6, 90, 6) if a != b and dots[a, b] > 5.0}
    assert len(near & set(found)) >= 0.9 * len(near) > 100


def test_hybrid_scores_pairs_that_can_win_only(spark):
    rng = random.Random(8)
    ids = range(80)
    vec = lambda: [rng.gauss(0, 1) * 0.2 + 1.0 for _ in range(3)]
    index = spark.createDataFrame([(i, f, vec()) for i in ids for f in search.FIELDS], "post_id long, field string, vector array<double>")
    qd = spark.createDataFrame([(j, f, vec()) for j in range(6) for f in search.FIELDS], "query_id long, field string, vector array<double>")
    postings = spark.createDataFrame([(i, f, t, rng.random() ** 4) for i in ids for f in search.FIELDS for t in ("a", "b")],
                                     "post_id long, field string, term string, weight double")
    qs = spark.createDataFrame([(j, t, rng.random()) for j in range(6) for t in ("a", "b")], "query_id long, term string, weight double")
    some = search.hybrid_scores(qd, index, qs, postings, 3, ranked=False)
    every = search.hybrid_scores(qd, index, qs, postings, 1000, ranked=False)
    assert every.count() == 480 and some.count() < 300
    top = lambda df: {(r.query_id, r.post_id, r.sim, r.rank) for r in SP.rank_results(df, 3).collect()}
    assert top(some) == top(every)


def test_context_features_move_token_and_path_only(spark):
    rows = [(1, 0, 0, "Foo", "0101"), (1, 0, 1, "bar.x()", "11"), (1, 1, 0, "of", "")]
    tok = spark.createDataFrame(rows, "id int, sent_no int, pos int, token string, brown string")
    got = {(r.sent_no, r.pos): r.features for r in EN.context_features(tok, ["id", "sent_no"]).collect()}
    assert {"wl[-1]|wl[0]=foo|bar.x()", "brown-p2[-1]=01", "brown-p4[0]=11", "__EOS__"} <= set(got[0, 1])
    assert {"w[0]|w[1]=Foo|bar.x()", "brown-p14[0]=0101", "brown-p2[1]=11", "__BOS__"} <= set(got[0, 0])
    assert not any(x.startswith(("w[-1]", "brown[1]")) for x in got[1, 0])


def test_cooccurrence_counts_each_pair_once(spark):
    rng = random.Random(4)
    docs = [[f"w{int(12 * rng.random() ** 2)}" for _ in range(rng.randrange(0, 40))] for _ in range(30)]
    df = spark.createDataFrame([(d,) for d in docs], "tokens array<string>")
    want = defaultdict(float)
    for d in docs:
        for i, a in enumerate(d):
            for j in range(i + 1, min(len(d), i + 4)):
                want[a, d[j]] += 1 / (j - i)
                want[d[j], a] += 1 / (j - i)
    x = MD.cooccurrence_counts(df, "tokens", 3)
    assert {(r.a, r.b): round(r.x, 9) for r in x.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert "Union" not in plan(x)


def test_ngrams_of_unseen_words_are_not_broadcast(spark):
    """The n-grams of a few words are many rows: judged by the size of the words,
    they would be broadcast from the driver."""
    import numpy as np
    from quarry.operators import models as MD
    words = ["collection", "collector", "iterator"]
    vec = {w: np.eye(3)[i] for i, w in enumerate(words)}
    table = MD.subword_table(spark.createDataFrame([(w, vec[w].tolist()) for w in words], "token string, vector array<double>"))
    bad = MD.materialize(spark.createDataFrame([("colection",), ("colection",), (None,)], "token string"))
    out = MD.unseen_word_vectors(bad, table)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    grams = lambda w: {f"<{w}>"[i:i + n] for n in (3, 4, 5, 6) for i in range(len(w) + 3 - n)}
    mean = {g: np.mean([vec[w] for w in words if g in grams(w)], axis=0) for w in words for g in grams(w)}
    rows = out.collect()
    assert [r.token for r in rows] == ["colection"]
    assert np.allclose(rows[0].vector, np.mean([mean[g] for g in grams("colection") if g in mean], axis=0))
