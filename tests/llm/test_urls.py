import random

import pytest
from pyspark.sql import types as T

from quarry.llm import urls
from quarry.llm.queries import URL_RULES

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType())]
                      + [T.StructField(c, T.StringType()) for c in ("label", "host", "features", "suffix", "share", "score")])


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"abcdef") for r in rows], SCHEMA)


def split(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    cut = min(ends, default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return host, path


def rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


ODD = [None, "", "no scheme", "http://", "http://Com/", "http://com", "http://com?x=/", "http://a.EXAMPLE.com/en/1?p=1&q=2#z",
       "http://www.example.com/en/", "http://x.www.example.com/en/2", "http://www.example.com/e", "http://notexample.com/en/",
       "http://net/es/", "http://b.net/fr/x", "http://b.net/de/", "a://b://c/d", "http://u:p@x.net:80/es/", "http://İx.com/",
       "http://x.com/é漢?é", "http:///path", "http://.net/es/", "http://" + "a." * 3000 + "net/fr/", "http://x.org/" + "y" * 200_000]


def make(n=400):
    rng = random.Random(1)
    out = [(1000 + i, u) for i, u in enumerate(ODD)]
    for i in range(n):
        host = rng.choice(["", "www.", "m."]) + rng.choice(["aa", "bb", "cheap-9-pills"]) + "." + rng.choice(
            ["example.com", "example.net", "example.org"])
        out.append((i, f"http://{host}/{rng.choice(['en', 'fr', 'es', 'de'])}/{rng.randrange(999)}" + rng.choice(["", "?a=1&b=2", "#t"])))
    return out


def test_split_and_rules():
    by_host = urls.rule_table(URL_RULES)
    for _, u in make():
        host, path, _ = urls.split_url(u)
        assert (host, path) == split(u)
        got, want = urls.fitting_rule(by_host, host, path), rule(host, path)
        assert (got and got.name) == (want and want.name)


def test_verdicts(spark):
    rows = make() + [(5, "http://dup.org/"), (5, "http://dup.org/"), (None, "http://n.com/")]
    got = urls.judge(frame(spark, rows).repartition(3), URL_RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, u in rows:
        if i in (5, None):
            continue
        r, (host, path) = by[i], split(u)
        want = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, want and want.name)
        assert r.verdict == want.verdict if want else r.verdict in ("allow", "block") and 0 <= r.score <= 1


def test_trees_learn_lexical_labels(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.5
        host = (f"{rng.randrange(10**6)}-win-{rng.randrange(99)}" if bad else rng.choice(["river", "stone", "house"])) + ".org"
        rows.append((i, f"http://{host}/" + ("?" + "&".join(f"k{j}={rng.randrange(9)}" for j in range(6)) if bad else "about")))
        if i % 3:
            labels.append((i, float(bad)))
    lab = spark.createDataFrame(labels, "page_id long, label double")
    got = urls.judge(frame(spark, rows), [], labels=lab, trees=5).collect()
    ok = [(r.verdict == "block") == ("-win-" in r.host) for r in got if r.page_id % 3 == 0]
    assert sum(ok) / len(ok) > 0.97


def test_empty_and_one_label(spark):
    assert urls.judge(frame(spark, [(1, "x")]).limit(0), URL_RULES).collect() == []
    got = urls.judge(frame(spark, [(1, "http://x.org/"), (2, None)]), URL_RULES).collect()
    assert {r.verdict for r in got} == {"allow"}


@pytest.mark.parametrize("s,h", [("", 0.0), ("aaaa", 0.0), ("abab", 1.0), ("abcd", 2.0)])
def test_entropy(s, h):
    assert urls.entropy(s) == pytest.approx(h)


def plain_features(u, host, path):
    """The lexical features, each written out anew."""
    import math
    from collections import Counter
    u = u or ""

    def bits(s):
        raw = s.encode()
        return -sum(c / len(raw) * math.log2(c / len(raw)) for c in Counter(raw).values()) if raw else 0.0

    rest = u.split("://", 1)[1] if "://" in u else ""
    before, _, after = rest.partition("?")
    query = "" if "#" in before else after.split("#", 1)[0]
    labels = host.split(".") if host else []
    return [len(u), len(host), len(path), len(labels), len([p for p in path.split("/") if p]),
            len([c for c in u if c.isdigit()]) / max(1, len(u)), len([c for c in host if c.isdigit()]) / max(1, len(host)),
            bits(u), bits(host), len([p for p in query.split("&") if p]), len(query), u.count("-"),
            max([0, *map(len, labels)]), 1.0 if "#" in u else 0.0, 1.0 if u.startswith("https:") else 0.0]


def test_features_and_tree_votes_recomputed(spark):
    """Every feature from its definition, and every score from the votes of the
    single trees."""
    import math
    from pyspark.ml.linalg import Vectors
    from pyspark.sql import functions as F
    rows = make(300)
    df = frame(spark, rows)
    parsed = urls.parsed(df, URL_RULES)
    label = F.when(F.col("rule_verdict").isNotNull(), (F.col("rule_verdict") == "block").cast("double"))
    labelled = parsed.withColumn("label", label)
    model, stats, _ = urls.train(labelled)
    by = {r.page_id: r for r in labelled.collect()}
    seen = {}
    for r in by.values():
        if r.label is not None:
            n, b = seen.get(r.suffix, (0, 0))
            seen[r.suffix] = (n + 1, b + r.label)
    score = {r.page_id: r for r in urls.judge(df, URL_RULES).collect()}
    full = {r.page_id: r.features for r in urls.with_features(labelled, stats).collect()}
    tested = 0
    for i, u in rows:
        host, path = split(u)
        want = plain_features(u, host, path)
        assert by[i].lexical == pytest.approx(want) and by[i].suffix == ".".join(host.split(".")[-2:])
        n, b = seen.get(by[i].suffix, (0, 0))
        own = by[i].label
        share = (b - (own or 0) + 5) / (n - (own is not None) + 10)
        assert list(full[i]) == pytest.approx([*want, share])
        if own is None and tested < 40:
            x = Vectors.dense([*want, share])
            margin = sum(w * t.predict(x) for w, t in zip(model.treeWeights, model.trees))
            p = 1 / (1 + math.exp(-2 * margin))
            assert score[i].score == pytest.approx(p) and score[i].verdict == ("block" if p >= 0.5 else "allow")
            tested += 1
    assert tested == 40 and model.getNumTrees == 20
