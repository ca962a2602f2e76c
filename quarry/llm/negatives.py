"""Hard negatives by angular triangle filtering.

Components become integers floor(scale * x); a score is the integer inner
product of two vectors.  Every vector keeps its norm and its angles to
``n_references`` reference directions.  For two vectors and a direction r the
angles obey

    |A(a, r) - A(x, r)| <= A(a, x) <= min(A(a, r) + A(x, r), 2 pi - A(a, r) - A(x, r)),

so the directions together leave an interval for the angle, its cosines one for
the cosine, and the norms turn that into bounds of the score.  The interval is
widened by more than the angles can be off by rounding (``_slack``), so a score
never lies outside its bounds.

Round one finds each anchor's positives, the ``n_positives`` rows of its label
that score highest: a row is scored only if its upper bound reaches the worst
positive so far.  Round two knows the window of scores that each (anchor,
positive) allows and scores a row of another label only if its bounds overlap
what is still open of a window.  Anchors are a stated set; blocks of ``block``
anchors meet every row, and each block is written and released before the next.

Defined results: rows with a null id, label or vector, or with null or
non-finite components, take no part; vectors of another length than the
anchor's are never its positives or negatives; ties go to the smaller id; rows
that repeat an id are candidates of their own (but for an anchor of that id; a
positive of two rows is listed for each), and of anchors that repeat an id the first by label and components counts;
anchors without another row of their label, and positives with an empty window
(negative scores), give no rows; a zero vector scores 0 with all; an empty table
gives no rows; other columns are ignored.  Scores beyond 64 bits are held at the
limits of 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

_TABLE = "id long, label long, dim int, v binary, norm double, angles binary"
_I64 = np.iinfo(np.int64)
_EPS = float(np.finfo(np.float64).eps)


def _slack(dim: int) -> float:
    """More than a computed angle can differ from the true one.  A computed
    cosine of unit vectors of ``dim`` components is off by at most d = (2 dim +
    16) eps (products and sums of the dot product and of both norms), and
    |arccos(c) - arccos(c + d)| <= arccos(1 - d) < 2 sqrt(d) for any c."""
    return 2 * np.sqrt((2 * dim + 16) * _EPS) + 8 * _EPS


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(x * scale), -2.0 ** 62, 2.0 ** 62).astype(np.int64)


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows (0 for zero rows) and norms of integer rows."""
    f = v.astype(np.float64)
    most = np.abs(f).max(axis=1, initial=0)
    f = f / np.where(most > 0, most, 1)[:, None]
    n = np.sqrt((f * f).sum(1))
    return f / np.where(n > 0, n, 1)[:, None], n * most


def angles_to(u: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ refs.T, -1, 1))


def choose_references(sample: np.ndarray, n: int) -> np.ndarray:
    """Directions out of a bounded sample of unit vectors, each the one least
    aligned with those before it."""
    if not len(sample):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    chosen, most = [0], np.abs(sample @ sample[0])
    while len(chosen) < min(n, len(sample)):
        nxt = int(most.argmin())
        if most[nxt] > 1 - 1e-9:
            break
        chosen.append(nxt)
        most = np.maximum(most, np.abs(sample @ sample[nxt]))
    return sample[chosen]


def _prepare(scale: int, refs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, label, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if i is None or label is None or v.as_py() is None or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                c = integers(x, scale)
                u, norm = unit(c[None])
                a = angles_to(u, refs)[0].tobytes() if len(refs) and len(c) == refs.shape[1] else b""
                out.append((i, label, len(c), c.tobytes(), float(norm[0]), a))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.binary())
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["id", "label", "dim", "v", "norm", "angles"])
    return run


class Rows:
    """Rows of one vector length as arrays."""

    def __init__(self, ids, labels, v, norms, angles):
        self.ids, self.labels, self.v, self.norms, self.angles = ids, labels, v, norms, angles

    @staticmethod
    def of(rows: list[tuple], dim: int) -> Rows:
        """``rows``: (id, label, v, norm, angles) in the table's binary form."""
        angles = None
        if all(r[4] for r in rows):
            angles = np.frombuffer(b"".join(r[4] for r in rows), np.float64).reshape(len(rows), -1)
        return Rows(np.asarray([r[0] for r in rows], np.int64), np.asarray([r[1] for r in rows], np.int64),
                    np.frombuffer(b"".join(r[2] for r in rows), np.int64).reshape(len(rows), dim),
                    np.asarray([r[3] for r in rows], np.float64), angles)


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, Rows]]:
    dims = batch.column(2).to_numpy()
    for d in np.unique(dims):
        part = batch.filter(pa.array(dims == d))
        yield int(d), Rows.of(list(zip(*(part.column(c).to_pylist() for c in (0, 1, 3, 4, 5)))), int(d))


def score_bounds(a: Rows, i: int, x: Rows, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of anchor i's scores with the rows of x."""
    n = a.norms[i] * x.norms * (1 + 64 * _EPS) + 1.0
    if a.angles is None or x.angles is None or a.angles.shape[1] != x.angles.shape[1] or not a.angles.shape[1]:
        return -n, n
    both = x.angles + a.angles[i]
    near = np.abs(x.angles - a.angles[i]).max(1)
    far = np.minimum(both, 2 * np.pi - both).min(1)
    slack = 2 * _slack(dim)
    low, high = np.cos(np.minimum(far + slack, np.pi)), np.cos(np.maximum(near - slack, 0))
    # beside the products' rounding, one unit for that of the cosines
    edge = 64 * _EPS * n + 1.0
    return low * n - edge, high * n + edge


def scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where every partial sum stays below
    2^53, else with Python's integers."""
    most = max(1, int(np.abs(v).max(initial=0))) * max(1, int(np.abs(q).max(initial=0)))
    if most * max(1, len(q)) < 2 ** 52:
        return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    prod = (v.astype(object) * q.astype(object)[None, :]).sum(1) if len(q) else np.zeros(len(v), object)
    return np.asarray([min(max(int(p), _I64.min), _I64.max) for p in prod], dtype=np.int64)


class Best:
    """The k best (score, id), best first, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.s, self.i = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def worst(self) -> float:
        """A score below this cannot get in."""
        return float(self.s[-1]) if len(self.s) == self.k else -np.inf

    def offer(self, s: np.ndarray, i: np.ndarray) -> None:
        s, i = np.concatenate([self.s, s]), np.concatenate([self.i, i])
        keep = np.lexsort((i, ~s))[:self.k]   # ~s falls as s rises and never overflows
        self.s, self.i = s[keep], i[keep]


def _positives(anchors, k: int, step: int = 256):
    """``anchors``: a broadcast of {dim: Rows}."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = anchors.value
        best = {d: [Best(k) for _ in a.ids] for d, a in blocks.items()}
        for b in batches:
            for d, x in by_length(b):
                if d not in blocks:
                    continue
                a = blocks[d]
                for i in range(len(a.ids)):
                    mine = np.flatnonzero((x.labels == a.labels[i]) & (x.ids != a.ids[i]))
                    if not len(mine):
                        continue
                    part = Rows(x.ids[mine], x.labels[mine], x.v[mine], x.norms[mine],
                                None if x.angles is None else x.angles[mine])
                    _, high = score_bounds(a, i, part, d)
                    top = best[d][i]
                    order = np.flatnonzero(high >= top.worst())
                    order = order[np.argsort(-high[order], kind="stable")]
                    for at in range(0, len(order), step):
                        now = order[at:at + step]
                        if high[now[0]] < top.worst():
                            break
                        top.offer(scores(part.v[now], a.v[i]), part.ids[now])
        out = [(int(a.ids[i]), int(x), int(s)) for d, a in blocks.items() for i in range(len(a.ids))
               for s, x in zip(best[d][i].s, best[d][i].i)]
        cols = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                         names=["anchor_id", "positive_id", "positive_score"])
    return run


def window_of(positive_score: int, low: int, high: int) -> tuple[int, int]:
    """The integer scores s with low * p <= 100 s <= high * p; empty if the first is the larger."""
    return -((-low * positive_score) // 100), (high * positive_score) // 100


def open_rows(low: np.ndarray, high: np.ndarray, windows: list[tuple[int, int]], best: list[Best]) -> np.ndarray:
    """Which rows' bounds overlap what is still open of a window."""
    wanted = np.zeros(len(low), bool)
    for (lo, hi), b in zip(windows, best):
        if lo <= hi:
            wanted |= (high >= max(float(lo), b.worst())) & (low <= float(hi))
    return wanted


def _negatives(anchors, k: int):
    """``anchors``: a broadcast of {dim: (Rows, per anchor its (positive place, window))}."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = anchors.value
        best = {d: [[Best(k) for _ in w] for w in ws] for d, (_, ws) in blocks.items()}
        for b in batches:
            for d, x in by_length(b):
                if d not in blocks:
                    continue
                a, ws = blocks[d]
                for i, windows in enumerate(ws):
                    low, high = score_bounds(a, i, x, d)
                    spans = [w for _, w in windows]
                    rows = np.flatnonzero((x.labels != a.labels[i]) & open_rows(low, high, spans, best[d][i]))
                    if not len(rows):
                        continue
                    s = scores(x.v[rows], a.v[i])
                    for (lo, hi), top in zip(spans, best[d][i]):
                        fits = np.flatnonzero((s >= max(lo, _I64.min)) & (s <= min(hi, _I64.max)))
                        if len(fits):
                            top.offer(s[fits], x.ids[rows[fits]])
        out = [(int(a.ids[i]), place, int(x), int(s)) for d, (a, ws) in blocks.items() for i, windows in enumerate(ws)
               for (place, _), top in zip(windows, best[d][i]) for s, x in zip(top.s, top.i)]
        cols = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
            names=["anchor_id", "place", "negative_id", "negative_score"])
    return run


def hard_negatives(items: DataFrame, is_anchor: Callable[[Column], Column], id_col: str = "vec_id",
                   vec_col: str = "embedding", label_col: str = "label", *, n_positives: int = 5, n_negatives: int = 3,
                   low: int = 50, high: int = 95, scale: int = 256, n_references: int = 16, sample: int = 1024,
                   block: int = 2048) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score: for each row whose id ``is_anchor`` accepts and each of its
    positives, the first ``n_negatives`` rows of other labels whose score lies
    between ``low`` and ``high`` percent of the positive's.  Labels are
    integers.  References come from the ``sample`` rows of smallest hashed id;
    they steer which rows are scored, never the result."""
    spark = items.sparkSession
    src = items.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("long").alias("l"), F.col(vec_col).alias("v"))
    none = np.zeros((0, 0))
    drawn = (src.filter("v is not null").orderBy(F.xxhash64("i"), "i", F.hash("v")).limit(sample)
             .mapInArrow(_prepare(scale, none), _TABLE).select("dim", "v").collect())
    common = max((r.dim for r in drawn), key=[r.dim for r in drawn].count, default=0)
    same = [np.frombuffer(r.v, np.int64) for r in drawn if r.dim == common]
    u = unit(np.asarray(same))[0] if same and common else none
    refs = choose_references(u[(u != 0).any(1)], n_references) if len(u) else none
    tab = staged(src.mapInArrow(_prepare(scale, refs), _TABLE), "angles")
    chosen = tab.filter(F.coalesce(is_anchor(F.col("id")), F.lit(False)))
    blocks = max(1, -(-chosen.count() // block))
    out = None
    for n in range(blocks):
        mine = _block(chosen.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).collect())
        part = _mine(spark, tab, mine, n_positives, n_negatives, low, high)
        out = part if out is None else out.unionByName(part)
    return out


def _block(rows) -> dict[int, Rows]:
    firsts: dict = {}
    for r in sorted(rows, key=lambda r: (r.id, r.label, np.frombuffer(r.v, np.int64).tolist())):
        firsts.setdefault(r.id, r)
    dims: dict = {}
    for r in firsts.values():
        dims.setdefault(r.dim, []).append((r.id, r.label, bytes(r.v), r.norm, bytes(r.angles)))
    return {d: Rows.of(rs, d) for d, rs in dims.items()}


def _mine(spark, tab: DataFrame, anchors: dict[int, Rows], n_positives: int, n_negatives: int, low: int,
          high: int) -> DataFrame:
    """Both rounds for one block of anchors."""
    sent = spark.sparkContext.broadcast(anchors)
    near = tab.mapInArrow(_positives(sent, n_positives), "anchor_id long, positive_id long, positive_score long")
    by = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = staged(near.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= n_positives), "positives")
    sent.destroy()
    windows: dict = {}
    for r in near.collect():   # block * n_positives rows at most
        windows.setdefault(r.anchor_id, []).append((r.place, window_of(r.positive_score, low, high)))
    sent = spark.sparkContext.broadcast(
        {d: (a, [sorted(windows.get(int(i), [])) for i in a.ids]) for d, a in anchors.items()})
    far = tab.mapInArrow(_negatives(sent, n_negatives), "anchor_id long, place int, negative_id long, negative_score long")
    by = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    far = staged(far.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n_negatives), "negatives")
    sent.destroy()
    return near.join(far, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
