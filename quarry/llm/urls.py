"""URL filter: host and path rules, and gradient-boosted trees for the rest.

A rule (verdict, host, path) fits its host and all its subdomains when the
path of the url starts with the rule's path; the longest fitting rule decides.
Urls without a fitting rule get the verdict of gradient-boosted trees over
lexical features of the url: lengths, depth, digit ratio, character entropy,
parameter counts and the labelled share of its host suffixes.

Defined results: a null url, or one without ``://``, has an empty host and
path and is judged by the trees; repeated rows are judged row by row; an empty
table gives no rows; with no labelled urls, or one label only, that label (or
``allow``) is the verdict of every url without a rule; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

_PARTS = re.compile(r"://([^/?#]*)([^?#]*)(?:\?([^#]*))?")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LEXICAL = ("url_length", "host_length", "path_length", "host_labels", "path_depth", "digit_ratio",
            "host_digit_ratio", "entropy", "host_entropy", "parameters", "query_length", "hyphens", "longest_label",
            "has_fragment", "is_https")
FEATURES = (*_LEXICAL, "suffix_block_share")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str, str]:
    """(host, path, query) of a url."""
    m = _PARTS.search(url or "")
    if not m:
        return "", "", ""
    return m[1].translate(_UPPER), m[2], m[3] or ""


def rule_table(rules: list[Rule]) -> dict[str, list[Rule]]:
    """host -> its rules, longest path first (one entry per host, so a lookup
    costs a url's labels, however many rules there are)."""
    out: dict[str, list[Rule]] = {}
    for r in sorted(rules, key=lambda r: (-len(r.path), r.path, r.verdict)):
        out.setdefault(r.host, []).append(r)
    return out


def fitting_rule(by_host: dict, host: str, path: str) -> Rule | None:
    best, suffix = None, host
    while suffix:
        for r in by_host.get(suffix, ()):
            if path.startswith(r.path):
                if best is None or len(r.name) > len(best.name):
                    best = r
                break
        suffix = suffix.partition(".")[2]
    return best


def entropy(s: str) -> float:
    if not s:
        return 0.0
    p = np.unique(np.frombuffer(s.encode(), np.uint8), return_counts=True)[1] / len(s.encode())
    return float(-(p * np.log2(p)).sum())


def lexical(url: str, host: str, path: str, query: str) -> list[float]:
    labels = host.split(".") if host else []
    digits = sum(c.isdigit() for c in url)
    return [len(url), len(host), len(path), len(labels), sum(1 for p in path.split("/") if p),
            digits / max(1, len(url)), sum(c.isdigit() for c in host) / max(1, len(host)), entropy(url), entropy(host),
            sum(1 for p in query.split("&") if p), len(query), url.count("-"),
            max(map(len, labels), default=0), float("#" in url), float(url.startswith("https:"))]


def _parse(rules: list[Rule]):
    names = ["page_id", "host", "path", "rule", "rule_verdict", "suffix", "lexical"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host = rule_table(rules)
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for u in b.column(1).to_pylist():
                host, path, query = split_url(u)
                r = fitting_rule(by_host, host, path)
                row = (host, path, r and r.name, r and r.verdict, ".".join(host.split(".")[-2:]),
                       lexical(u or "", host, path, query))
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.string()] * 5 + [pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)
    return run


def parsed(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, rule_verdict, suffix (the last two labels of
    the host), lexical features."""
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")) \
        .mapInArrow(_parse(rules), "page_id long, host string, path string, rule string, rule_verdict string, "
                                   "suffix string, lexical array<double>")


def suffix_stats(labelled: DataFrame) -> DataFrame:
    """suffix -> number of labelled urls and of block labels.  One row per
    suffix; it is joined, not collected."""
    return labelled.groupBy("suffix").agg(F.sum("label").alias("blocks"), F.count(F.lit(1)).alias("urls"))


def with_features(rows: DataFrame, stats: DataFrame, prior: float = 10.0) -> DataFrame:
    """Adds ``features``.  The share of block labels of a suffix is drawn
    towards one half by ``prior`` labels; a row's own label is not counted."""
    joined = rows.join(stats, "suffix", "left")
    own, known = F.coalesce("label", F.lit(0.0)), F.col("label").isNotNull().cast("int")
    share = ((F.coalesce("blocks", F.lit(0.0)) - own + prior / 2)
             / (F.coalesce("urls", F.lit(0)) - known + prior))
    return joined.withColumn("features", array_to_vector(F.concat("lexical", F.array(share)))).drop("blocks", "urls")


def train(rows: DataFrame, *, sample: int = 100_000, trees: int = 20, depth: int = 4,
          seed: int = 7) -> tuple[GBTClassificationModel | None, DataFrame, float]:
    """Fit on rows with a ``label`` (1.0: block).  At most ``sample`` labelled
    rows, those of smallest hashed id, grow the trees; suffix statistics come
    from all labelled rows.  Returns (model or None, statistics, share of
    block labels)."""
    labelled = rows.filter("label is not null")
    stats = staged(suffix_stats(labelled), "suffix-stats")
    n, mean = labelled.agg(F.count(F.lit(1)), F.coalesce(F.avg("label"), F.lit(0.0))).first()
    if n == 0 or mean in (0.0, 1.0):
        return None, stats, mean
    chosen = labelled.orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    data = with_features(chosen, stats).select("features", "label")
    data = staged(data, "url-sample")
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.2, subsamplingRate=1.0,
                        cacheNodeIds=False)
    return gbt.fit(data), stats, mean


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
          labels: DataFrame | None = None, **options) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (the trees'
    probability of block; null where a rule decides).

    ``labels`` (page_id, label: 1 block, 0 allow) are the labelled urls; by
    default the urls that a rule fits are, with the rule's verdict."""
    rows = parsed(pages, rules, id_col, url_col)
    if labels is None:
        rows = rows.withColumn("label", F.when(F.col("rule_verdict").isNotNull(),
                                               (F.col("rule_verdict") == "block").cast("double")))
    else:
        rows = rows.join(labels.select(F.col("page_id").cast("long").alias("page_id"),
                                       F.col("label").cast("double").alias("label")), "page_id", "left")
    rows = staged(rows, "urls")
    model, stats, mean = train(rows, **options)
    if model is None:
        scored = rows.withColumn("score", F.lit(float(mean)))
    else:
        scored = model.transform(with_features(rows, stats)).withColumn(
            "score", F.element_at(vector_to_array(F.col("probability")), 2))
    ruled = F.col("rule").isNotNull()
    verdict = F.when(ruled, F.col("rule_verdict")).when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"),
                         F.when(~ruled, F.col("score")).alias("score"))
