"""Best tag sequences, sub-sampling, unseen words, out-of-fold measures, word
vector files and parameter files."""

import hashlib
import itertools
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import dense as D
from quarry.operators import models as MD
from quarry.plans import jobs
from quarry.sources import files

TAGS = ["O", "B-x", "I-x", "B-y", "I-y"]


def test_best_path_equals_trying_all(spark):
    rng = random.Random(5)
    start = [rng.gauss(0, 1) if MD.may_follow(None, t) else MD._NEVER for t in TAGS]
    steps = [[rng.gauss(0, 2) if MD.may_follow(a, b) else MD._NEVER for b in TAGS] for a in TAGS]
    rows = [(i, [[rng.gauss(0, 1) for _ in TAGS] for _ in range(rng.randrange(1, 6))]) for i in range(40)]
    rows.append((99, [[0.0] * 5 for _ in range(3000)]))   # a very long sentence
    df = spark.createDataFrame(rows, "id long, e array<array<double>>")
    got = {r.id: r.path for r in df.select("id", MD.best_path(F.col("e"), start, steps).alias("path")).collect()}
    for i, e in rows[:-1]:
        def score(path):
            return start[path[0]] + sum(e[n][t] for n, t in enumerate(path)) + sum(steps[a][b] for a, b in zip(path, path[1:]))
        best = max(itertools.product(range(5), repeat=len(e)), key=score)
        assert math.isclose(score(got[i]), score(best), abs_tol=1e-9)
    assert len(got[99]) == 3000
    for path in got.values():
        tags = [TAGS[j] for j in path]
        assert all(MD.may_follow(a, b) for a, b in zip([None, *tags], tags))


def test_transitions_count_sentences(spark):
    rows = [(1, 0, "O"), (1, 1, "B-x"), (1, 2, "I-x"), (2, 0, "B-x"), (2, 1, "O")]
    df = spark.createDataFrame(rows, "s long, pos int, tag string")
    start, steps = MD.tag_transitions(df, TAGS, ["s"], smoothing=1.0)
    assert start[2] == start[4] == MD._NEVER and steps[0][2] == MD._NEVER and steps[1][4] == MD._NEVER
    share = {t: (c + 1) / 10 for t, c in {**dict.fromkeys(TAGS, 0), **Counter(t for *_, t in rows)}.items()}
    assert math.isclose(start[0], math.log(2 / 5 / share["O"]))       # O, B-x and B-y may begin: 1 + 1 of 2 + 3
    assert math.isclose(steps[1][2], math.log(2 / 6 / share["I-x"]))  # after B-x: O, B-x, I-x, B-y


def test_subsample_keeps_by_hashed_position(spark):
    docs = [(i, ["the"] * 30 + [f"w{i}"]) for i in range(30)] + [(99, [])]
    df = spark.createDataFrame(docs, "id long, tokens array<string>").repartition(3)
    n = Counter(t for _, ts in docs for t in ts)
    total = sum(n.values())

    def keep(i, pos, t):
        x = 1e-2 / (n[t] / total)
        u = int(hashlib.md5(f"{i}:{pos}".encode()).hexdigest()[:8], 16) / 2 ** 32
        return u < min(1.0, math.sqrt(x) + x)

    got = {r.id: r.tokens for r in MD.subsample(df, "id", threshold=1e-2).collect()}
    assert got == {i: [t for p, t in enumerate(ts) if keep(i, p, t)] for i, ts in docs}
    assert 0 < sum(len(t) for t in got.values()) < 0.3 * total


def test_misspelt_words_lie_near_the_right_one(spark):
    rng = np.random.default_rng(3)
    words = ["collection", "connection", "repository", "serializer", "validation", "transaction", "scheduler", "navigator"]
    vec = {w: rng.standard_normal(24).tolist() for w in words}
    wv = spark.createDataFrame(list(vec.items()), "token string, vector array<double>")
    table = MD.subword_table(wv)
    bad = {w[:4] + w[5:]: w for w in words}
    df = spark.createDataFrame([(b,) for b in bad] + [("qqq",)], "token string")
    got = {r.token: np.asarray(r.vector) for r in MD.unseen_word_vectors(df, table).collect()}
    assert set(got) == set(bad)
    for b, w in bad.items():
        sims = {x: float(got[b] @ np.asarray(v) / np.linalg.norm(got[b]) / np.linalg.norm(v)) for x, v in vec.items()}
        assert max(sims, key=sims.get) == w
    tokens = spark.createDataFrame([("collection",), ("collction",), ("qqq",)], "token string")
    found = {r.token: r.vector for r in D.lookup_vectors(tokens, wv, oov="skip", subwords=table).collect()}
    assert set(found) == {"collection", "collction"} and np.allclose(found["collection"], vec["collection"])
    assert {r[0] for r in spark.range(1).select(F.explode(MD.character_grams(F.lit("ab"), (3, 4)))).collect()} == {"<ab", "ab>", "<ab>"}


def test_measures_over_the_folds(spark):
    rows = [(0, f, i, int(i % 3 == 0), int(i % 3 == 0 or i % 7 == f)) for f in range(3) for i in range(40)]
    rows += [(1, f, i, 0, 0) for f in range(3) for i in range(5)]
    got = {r.setting: r for r in MD.fold_scores(spark.createDataFrame(rows, "setting int, fold int, id long, label int, pred int")).collect()}
    acc = [np.mean([x == y for s, g, _, x, y in rows if s == 0 and g == f]) for f in range(3)]
    assert math.isclose(got[0].accuracy_mean, np.mean(acc)) and math.isclose(got[0].accuracy_std, np.std(acc), abs_tol=1e-12)
    assert got[0].precision_mean < 1 and got[0].f1_mean < 1 and got[1].accuracy_mean == 1 and got[1].f1_mean == 0
    assert MD.grid(a=[1, 2], b=["x"]) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]


def test_word_vector_files_and_their_headers(spark, tmp_path):
    for name, text in (("a", "3 2\nx 1 2\n3 2\ny 5 6\n"), ("b", "7 2\nz 0.5\n"), ("c", "2 1\np 4\nq 5\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "v.vec").write_text(text)
    rows = lambda *names: sorted((r.token, list(r.vector)) for n in names
                                 for r in files.read_word_vectors(spark, str(tmp_path / n)).collect())
    assert rows("b") == [("7", [2.0]), ("z", [0.5])]      # no header: one dimension, not seven rows
    assert rows("c") == [("p", [4.0]), ("q", [5.0])]
    (tmp_path / "a" / "w.vec").write_text("2 2\nu 7 8\nv 9 1\n")   # a header per file
    assert rows("a") == [("3", [2.0]), ("u", [7.0, 8.0]), ("v", [9.0, 1.0]), ("x", [1.0, 2.0]), ("y", [5.0, 6.0])]


GOOD = {"input": {"questions": "q", "answers": "a", "comments": "c", "postlinks": "l"}, "output": "/out/",
        "dataset": {"include": ["x"]}, "corpus": {}, "training": {"dim": 8, "sample": 1}, "index": {"sparse": False}}


def test_settings_are_typed():
    s = jobs.parse_settings(json.dumps(GOOD))
    assert s.output == "/out" and s.dataset.include == ["x"] and s.training.epochs == 24 and s.index.dense
    bad = [("outputs", 1), ("input", {"questions": "q"}), ("dataset", {"includes": []}), ("dataset", {"include": "x"}),
           ("training", {"dim": "8"}), ("training", {"dim": True}), ("index", []), ("output", 3),
           ("input", {"questions": "q", "answers": "a", "comments": "c"})]
    for key, value in bad:
        with pytest.raises(ValueError):
            jobs.parse_settings(json.dumps({**GOOD, key: value}))
    for missing in ("input", "output", "training"):
        with pytest.raises(ValueError):
            jobs.parse_settings(json.dumps({k: v for k, v in GOOD.items() if k != missing}))
