"""Quality classifier: a regularised quadratic discriminant.

Document statistics (lengths, character-class shares, repetition) are counted
over whole texts and transformed to be closer to normal: logarithms of counts,
arcsine roots of shares.  Each class has a mean and a covariance that is
shrunk towards the pooled covariance (``pool``) and then towards a scaled
identity (``ridge``).  A score is the logistic of the difference of the two
log densities, -(Mahalanobis distance)^2 / 2 - log|L|, and the log prior odds;
the inverse Cholesky factors are computed once and travel with the task.

Training sums counts, first and second moments per task and then over tasks,
so all labelled rows are used and the driver sees one sum per moment.

Defined results: null and empty texts have the statistics of an empty text and
get a score like any other; repeated rows are scored row by row and count once
each in training; labels other than 0 and 1, and null labels, are no labels; of
several labels of one document the largest counts; with one class missing every
score is 1.0 (only good labels) or 0.0 (only bad ones), without labels 0.5;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays, tokens
from .common import bounded, staged

STATISTICS = ("log_words", "log_word_bytes", "upper", "symbols", "bars", "exclamations", "stops", "digits",
              "beyond_ascii", "lines", "same_as_before", "log_type_share", "spread")
_CLASSES = ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"#$%&*@^~+=<>{}[]\\_`", 2), (b"|", 3), (b"!", 4), (b".,;:?", 5),
            (b"0123456789", 6), (bytes(range(128, 256)), 7), (b"\n", 8), (b" \t\r\x0b\x0c", 9))
_CLASS = np.zeros(256, np.uint8)
for _bytes, _k in _CLASSES:
    _CLASS[list(_bytes)] = _k


# Bytes of text whose statistics a task computes at a time: its arrays are some
# twelve times as large.
SLICE_BYTES = 1 << 20


def _counts(data: np.ndarray, off: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """Bytes of each class per text, over bounded pieces of the buffer."""
    n = len(off) - 1
    out = np.zeros((n, 10))
    for a in range(0, len(data), step):
        b = min(a + step, len(data))
        lo = int(np.searchsorted(off, a, side="right")) - 1
        hi = int(np.searchsorted(off, b, side="left"))
        lengths = np.minimum(off[lo + 1:hi + 1], b) - np.maximum(off[lo:hi], a)
        doc = np.repeat(np.arange(hi - lo, dtype=np.int32), lengths)
        doc *= 10
        doc += _CLASS[data[a:b]]
        out[lo:hi] += np.bincount(doc, minlength=(hi - lo) * 10).reshape(hi - lo, 10)
    return out


def statistics(texts) -> np.ndarray:
    """One row of transformed statistics per text of a string column."""
    data, off = tokens.buffers(texts)
    n = len(off) - 1
    if n == 0:
        return np.zeros((0, len(STATISTICS)))
    c = _counts(data, off)
    h, words = tokens.word_hashes(texts)
    doc = np.repeat(np.arange(n), words)
    same = np.zeros(n)
    kinds = np.zeros(n)
    if len(h):
        again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        same = np.bincount(doc[1:][again], minlength=n).astype(float)
        # distinct words per text: sort within the text by mixing its number in
        key = tokens.mix(h ^ tokens.mix(doc.astype(np.uint64)))
        order = np.argsort(key)
        first = tokens.runs(key[order])[0]
        kinds = np.bincount(doc[order[first]], minlength=n).astype(float)
    size = np.diff(off).astype(float)
    solid = np.maximum(size - c[:, 8] - c[:, 9], 1)
    w = np.maximum(words, 1).astype(float)

    def share(x, total):
        return np.arcsin(np.sqrt(np.clip(x / total, 0, 1)))

    return np.column_stack([
        np.log1p(words), np.log(solid / w), share(c[:, 1], solid), share(c[:, 2], solid), share(c[:, 3], solid),
        share(c[:, 4], solid), share(c[:, 5], solid), share(c[:, 6], solid), share(c[:, 7], solid),
        share(c[:, 8], w), share(same, w), np.log((kinds + 1) / (w + 1)),
        share(c[:, 1] + c[:, 2] + c[:, 3] + c[:, 4], solid)])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in arrays.slices(whole, 1, SLICE_BYTES):
            x = statistics(b.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["doc_id", "x"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the transformed statistics of every row."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(arrays.lean(_measure), "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    """Per class: mean, inverse Cholesky factor, sum of the logs of its
    diagonal; and the log prior odds.  ``constant`` replaces all that when a
    class has no labels."""
    means: tuple = ()
    inverse: tuple = ()
    logdet: tuple = ()
    log_odds: float = 0.0
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        lp = []
        for m, inv, ld in zip(self.means, self.inverse, self.logdet):
            z = (x - m) @ inv.T
            lp.append(-0.5 * (z * z).sum(1) - ld)
        return 1 / (1 + np.exp(-np.clip(lp[1] - lp[0] + self.log_odds, -700, 700)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(STATISTICS)
    sums = np.zeros((2, 1 + d + d * d))
    for b in batches:
        y = b.column(0).to_numpy()
        x = b.column(1).flatten().to_numpy().reshape(-1, d)
        for k in (0, 1):
            z = x[y == k]
            sums[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
    k, i = np.indices(sums.shape)
    yield pa.RecordBatch.from_arrays([pa.array(k.ravel(), pa.int32()), pa.array(i.ravel(), pa.int32()),
                                      pa.array(sums.ravel())], names=["k", "i", "v"])


def fit(sums: np.ndarray, pool: float, ridge: float) -> Model:
    """The model of (2, 1 + d + d^2) moment sums."""
    d = len(STATISTICS)
    n = sums[:, 0]
    if not n.all():
        return Model(constant=0.5 if not n.any() else float(n[1] > 0))
    means, covs = [], []
    for k in (0, 1):
        m = sums[k, 1:1 + d] / n[k]
        means.append(m)
        covs.append(sums[k, 1 + d:].reshape(d, d) / n[k] - np.outer(m, m))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    inverse, logdet = [], []
    for c in covs:
        s = (1 - pool) * c + pool * pooled
        s = (1 - ridge) * s + ridge * (np.trace(s) / d + 1e-6) * np.eye(d)
        factor = np.linalg.cholesky((s + s.T) / 2)
        inverse.append(np.linalg.inv(factor))
        logdet.append(float(np.log(np.diag(factor)).sum()))
    return Model(tuple(means), tuple(inverse), tuple(logdet), float(np.log(n[1] / n[0])))


def train(rows: DataFrame, labels: DataFrame, label_col: str = "quality", learn: Column | None = None, *,
          pool: float = 0.1, ridge: float = 0.001) -> Model:
    """Fit on the measured ``rows`` that have a label; ``learn`` (a condition
    on doc_id) limits the rows that may be learnt from."""
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
           .filter("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y")))
    if learn is not None:
        rows = rows.filter(learn)
    got = (rows.join(lab, "doc_id").select("y", "x")
           .mapInArrow(arrays.lean(_moments), "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect())
    d = len(STATISTICS)
    sums = np.zeros((2, 1 + d + d * d))
    for r in got:  # 2 * (1 + d + d^2) numbers
        sums[r.k, r.i] = r.v
    return fit(sums, pool, ridge)


def train_on(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
             text_col: str = "text", **options) -> Model:
    """``train`` on the documents that have a label: only these are measured."""
    ids = staged(labels.filter(F.col(label_col).isin(0, 1)).select(F.col("doc_id").cast("long").alias("labelled"))
                 .filter("labelled is not null").distinct(), "labelled-ids")
    some = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    some = some.join(bounded(ids), some[id_col] == ids["labelled"], "left_semi")
    return train(measured(some, id_col, text_col), labels, label_col, **options)


def _apply(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(STATISTICS)
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label_col: str = "quality",
          threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold) per row.
    The texts are read once: training and scoring share their statistics."""
    rows = staged(measured(docs, id_col, text_col), "quality-statistics")
    model = train(rows, labels, label_col, learn, **options)
    return (rows.mapInArrow(arrays.lean(_apply(model)), "doc_id long, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, unchanged."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in arrays.slices(whole, at, SLICE_BYTES):
                s = model.score(statistics(b.column(at)))
                yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(arrays.lean(run), docs.schema)
