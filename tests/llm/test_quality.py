import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import quality
from quarry.llm.common import fold

from .conftest import frame, prose


def junk(rng, n):
    return " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in prose(rng, n).split())


def labelled(spark, n=300):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, junk(rng, rng.randrange(5, 80)) if bad else prose(rng, rng.randrange(5, 80))))
        if i % 5:
            labels.append((i, 0 if bad else 1))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark, odd_rows):
    rows, labels = labelled(spark)
    lab = spark.createDataFrame(labels + [(None, 1), (3, None), (7, 5), (10_000, 1)], "doc_id long, quality int")
    odd = [(None if i is None else 1000 + i, t) for i, t in odd_rows]
    docs = frame(spark, rows + odd).repartition(4)
    got = quality.score(docs, lab, learn=fold(F.col("doc_id"), 5) != 0).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    held = [i for i, _ in rows if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([by[i].predicted == int(i % 4 != 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_moments_give_the_densities(spark):
    """Scores against densities with determinants and inverses."""
    rows, labels = labelled(spark, 200)
    y = dict(labels)
    x = quality.statistics(pa.array([t for i, t in rows if i in y]))
    k = np.asarray([y[i] for i, _ in rows if i in y])
    model = quality.train(quality.measured(frame(spark, rows)), spark.createDataFrame(labels, "doc_id long, quality int"),
                          pool=0.2, ridge=0.05)
    d = x.shape[1]
    cov = [np.cov(x[k == c].T, bias=True) for c in (0, 1)]
    pooled = sum(c * (k == i).mean() for i, c in enumerate(cov))
    lp = []
    for c in (0, 1):
        s = 0.8 * cov[c] + 0.2 * pooled
        s = 0.95 * s + 0.05 * (np.trace(s) / d + 1e-6) * np.eye(d)
        z = x - x[k == c].mean(0)
        lp.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) - 0.5 * np.linalg.slogdet(s)[1])
    want = 1 / (1 + np.exp(-np.clip(lp[1] - lp[0] + np.log((k == 1).sum() / (k == 0).sum()), -700, 700)))
    assert np.allclose(model.score(x), want, atol=1e-6)


def test_missing_classes_and_empty_tables(spark):
    docs = frame(spark, [(1, "a b c"), (2, None)])
    lab = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, lab).collect()} == {1.0}
    assert {r.score for r in quality.score(docs, lab.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.score(docs, lab.select("doc_id", (F.col("quality") - 1).alias("quality"))).collect()} == {0.0}
    assert quality.score(docs.limit(0), lab).collect() == []


def test_statistics_do_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = [prose(rng, 50), None, "", "x|y ! 3", prose(rng, 3000), "É é"]
    whole = quality.statistics(pa.array(texts))
    for t, row in zip(texts, whole):
        assert np.allclose(quality.statistics(pa.array([t], pa.string()))[0], row)


def test_keep_leaves_rows_alone(spark):
    rows, labels = labelled(spark, 100)
    docs = frame(spark, rows)
    model = quality.train(quality.measured(docs), spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns
    good = {i for i, _ in rows if i % 4}
    assert len({r.doc_id for r in kept.collect()} & good) > 0.9 * len(good)
    assert kept.exceptAll(docs).count() == 0


def test_memory_of_a_batch_and_kept_rows(spark):
    """Statistics need little memory beside their batch, and a batch of several
    slices keeps the rows that reach the threshold, unchanged."""
    import tracemalloc
    rng = random.Random(5)
    text = prose(rng, 400)
    n = 8_000_000 // len(text)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([text] * n)], names=["doc_id", "text"])
    tracemalloc.start()
    got = sum(b.num_rows for b in quality._measure(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == n and peak < 40 << 20

    rows, labels = labelled(spark)
    docs = frame(spark, rows + [(9001, None), (9002, ""), (5, rows[5][1]), (9003, prose(rng, 300_000)), (9004, junk(rng, 300_000))])
    model = quality.train_on(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = quality.keep(docs, model)
    assert kept.schema == docs.schema
    score = lambda t: model.score(quality.statistics(pa.array([t], pa.string())))[0]
    want = [tuple(r) for r in docs.collect() if score(r.text) >= 0.3]
    key = lambda r: (r[0], r[1] or "")
    assert sorted((tuple(r) for r in kept.collect()), key=key) == sorted(want, key=key) and 0 < len(want) < docs.count()
