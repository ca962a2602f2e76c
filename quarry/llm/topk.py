"""Exact top-k inner-product search by pivot-table elimination.

Components become integers floor(scale * x).  A pivot table holds every
vector's distance to ``n_pivots`` pivots.  By the triangle inequality
d(q, x) >= max over pivots of |d(q, p) - d(x, p)|, so with the norms

    q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2

has an upper bound that needs no product; |q| |x| is another.  Distances are
widened by more than they can be off by rounding (``_off``), so no bound is too
low.  Each task reads its part of the table in batches and evaluates, for every
query, candidates in falling order of their bound until it is below the k-th
score found so far; the search starts from the k-th score among the rows that
pivots are chosen from.  Queries are a stated set; they travel in blocks of
``block`` rows, every block meets every row of the table, and its results are
written before the next block is sent.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; vectors of another length than the query's are not candidates;
ties go to the smaller id; rows that repeat an id are candidates of their own,
and of queries that repeat an id the first by its components is searched; an
empty table gives no rows; other columns are ignored.  Scores beyond 64 bits
are held at the limits of 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

_TABLE = "id long, dim int, v binary, pd binary"
_I64 = np.iinfo(np.int64)


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    f = np.floor(x * scale)
    return np.clip(f, -2.0 ** 62, 2.0 ** 62).astype(np.int64)


def _vectors(b: pa.RecordBatch, scale: int) -> list[tuple[int, np.ndarray]]:
    """(id, integer components) of the rows that take part."""
    out = []
    for i, v in zip(b.column(0).to_pylist(), b.column(1)):
        if i is None or v.as_py() is None or v.values.null_count:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all():
            out.append((i, _integers(x, scale)))
    return out


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of v to the pivots of their length."""
    f = v.astype(np.float64)
    d2 = (f * f).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * f @ pivots.T
    return np.sqrt(np.maximum(d2, 0))


def _off(norms: np.ndarray, pivot_norm: float, dim: int) -> np.ndarray:
    """More than a computed distance to a pivot can differ from the true one:
    its square is off by at most (2 dim + 16) eps (|x| + |p|)^2, and the root of
    a number that is off by e by at most the root of e."""
    return np.sqrt((2 * dim + 16) * np.finfo(np.float64).eps) * (norms + pivot_norm)


def _prepare(scale: int, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _vectors(b, scale)
            pd = []
            for _, v in rows:
                fits = pivots.ndim == 2 and len(v) == pivots.shape[1]
                pd.append(_distances(v[None], pivots)[0].tobytes() if fits else b"")
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], pa.int64()), pa.array([len(v) for _, v in rows], pa.int32()),
                 pa.array([v.tobytes() for _, v in rows], pa.binary()), pa.array(pd, pa.binary())],
                names=["id", "dim", "v", "pd"])
    return run


def choose_pivots(sample: np.ndarray, n_pivots: int) -> np.ndarray:
    """Farthest-first pivots out of a bounded sample of vectors."""
    f = sample.astype(np.float64)
    if not len(f):
        return np.zeros((0, 0))
    chosen, far = [0], ((f - f[0]) ** 2).sum(1)
    while len(chosen) < min(n_pivots, len(f)):
        nxt = int(far.argmax())
        if far[nxt] == 0:
            break
        chosen.append(nxt)
        far = np.minimum(far, ((f - f[nxt]) ** 2).sum(1))
    return f[chosen]


class _Best:
    """The k best (score, id) per query, best first, ties to the smaller id."""

    def __init__(self, n: int, k: int, floors: np.ndarray | None = None):
        self.k, self.rows = k, [(np.empty(0, object), np.empty(0, np.int64))] * n
        self.floors = np.full(n, -np.inf) if floors is None else floors
        self.evaluated = 0

    def kth(self, q: int) -> float:
        """A score below this is not among the k best."""
        s = self.rows[q][0]
        return max(self.floors[q], float(s[-1]) if len(s) == self.k else -np.inf)

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s0, i0 = self.rows[q]
        s = np.concatenate([s0.astype(scores.dtype) if len(s0) else s0[:0].astype(scores.dtype), scores])
        i = np.concatenate([i0, ids])
        keep = np.lexsort((i, -s))[:self.k] if s.dtype != object else \
            np.asarray(sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:self.k], dtype=np.int64)
        self.rows[q] = (s[keep], i[keep])


def _scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where every partial sum stays below
    2^53, else with Python's integers."""
    most = max(1, int(np.abs(v).max(initial=0))) * max(1, int(np.abs(q).max(initial=0)))
    if most * max(1, len(q)) < 2 ** 52:
        return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    prod = (v.astype(object) * q.astype(object)[None, :]).sum(1) if len(q) else np.zeros(len(v), object)
    return np.asarray([min(max(int(p), _I64.min), _I64.max) for p in prod], dtype=np.int64)


def _search(queries, k: int, step: int = 256):
    """``queries``: a broadcast of {dim: (ids, integer matrix, pivot distances
    or None, largest norm of a pivot, scores to start from)}."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = queries.value
        best = {d: _Best(len(x[0]), k, x[4]) for d, x in blocks.items()}
        for b in batches:
            ids_all = b.column(0).to_numpy()
            dims = b.column(1).to_numpy()
            for d in np.unique(dims):
                if int(d) not in blocks:
                    continue
                rows = np.flatnonzero(dims == d)
                ids = ids_all[rows]
                v = np.frombuffer(b"".join(b.column(2)[int(r)].as_py() for r in rows), np.int64).reshape(len(rows), d)
                pd = [b.column(3)[int(r)].as_py() for r in rows]
                _batch(blocks[int(d)], best[int(d)], ids, v, pd, step)
        out = [(int(qid), int(i), int(s)) for d, x in blocks.items() for j, qid in enumerate(x[0])
               for s, i in zip(*best[d].rows[j])]
        cols = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                         names=["query_id", "vec_id", "score"])
    return run


def _batch(block, best: _Best, ids, v, pd, step: int) -> None:
    qids, qv, qd, pivot_norm, _ = block
    norms = (v.astype(np.float64) ** 2).sum(1)
    qnorms = (qv.astype(np.float64) ** 2).sum(1)
    off, qoff = (_off(np.sqrt(n), pivot_norm, v.shape[1]) for n in (norms, qnorms))
    table = np.frombuffer(b"".join(pd), np.float64).reshape(len(ids), -1) if qd is not None and all(pd) else None
    for lo in range(0, len(qids), step):
        hi = min(lo + step, len(qids))
        if table is None or table.shape[1] == 0:
            low = np.zeros((hi - lo, len(ids)))
        else:
            low = np.abs(qd[lo:hi, :1] - table[None, :, 0])
            for p in range(1, table.shape[1]):
                np.maximum(low, np.abs(qd[lo:hi, p:p + 1] - table[None, :, p]), out=low)
        low = np.maximum(low - off[None, :] - qoff[lo:hi, None], 0)
        # the squares' own rounding stays below this slack
        slack = 1.0 + 1e-9 * (qnorms[lo:hi, None] + norms[None, :])
        upper = (qnorms[lo:hi, None] + norms[None, :] - low * low) / 2
        upper = np.minimum(upper, np.sqrt(qnorms[lo:hi, None] * norms[None, :])) + slack
        for q in range(lo, hi):
            up = upper[q - lo]
            cand = np.flatnonzero((up >= best.kth(q)) & (ids != qids[q]))
            cand = cand[np.argsort(-up[cand], kind="stable")]
            for at in range(0, len(cand), step):
                part = cand[at:at + step]
                if up[part[0]] < best.kth(q):
                    break
                best.evaluated += len(part)
                best.offer(q, _scores(v[part], qv[q]), ids[part])


def starting_scores(qids, qv, ids, v, k: int) -> np.ndarray:
    """Per query the k-th best score among some rows of the table: what is
    below is not among the k best of all."""
    out = np.full(len(qids), -np.inf)
    for q in range(len(qids)):
        s = _scores(v[ids != qids[q]], qv[q])
        if len(s) >= k:
            out[q] = float(np.partition(s, len(s) - k)[len(s) - k])
    return out


def topk_search(items: DataFrame, is_query: Callable[[Column], Column], id_col: str = "vec_id", vec_col: str = "embedding", *,
                k: int = 10, scale: int = 1024, n_pivots: int = 32, pivot_sample: int = 1024,
                block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of highest
    integer inner product with each row whose id column ``is_query`` accepts, itself left out.  Pivots come from ``pivot_sample`` rows
    of smallest hashed id; they steer the order of work, never the result."""
    spark = items.sparkSession
    src = items.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col).alias("_v"))
    empty = np.zeros((0, 0))
    sample = (src.filter(F.col("_v").isNotNull())
              .orderBy(F.xxhash64(id_col), F.col(id_col), F.hash("_v")).limit(pivot_sample)
              .mapInArrow(_prepare(scale, empty), _TABLE).select("id", "dim", "v").collect())
    common = max((r.dim for r in sample), key=[r.dim for r in sample].count, default=0)
    drawn = {d: (np.asarray([r.id for r in sample if r.dim == d], np.int64),
                 np.asarray([np.frombuffer(r.v, np.int64) for r in sample if r.dim == d])) for d in {r.dim for r in sample}}
    pivots = choose_pivots(drawn[common][1], n_pivots) if sample else empty
    pivot_norm = float(np.sqrt((pivots * pivots).sum(1)).max(initial=0)) if pivots.ndim == 2 else 0.0
    tab = staged(src.mapInArrow(_prepare(scale, pivots), _TABLE), "pivot-table")
    qs = tab.filter(F.coalesce(is_query(F.col("id")), F.lit(False)))
    n = qs.count()
    found = None
    n_blocks = max(1, -(-n // block))
    for i in range(n_blocks):
        rows = qs.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == i).collect()
        firsts: dict = {}
        for r in sorted(rows, key=lambda r: (r.id, np.frombuffer(r.v, np.int64).tolist())):
            firsts.setdefault(r.id, r)
        dims: dict = {}
        for r in firsts.values():
            dims.setdefault(r.dim, []).append(r)
        packed = {}
        for d, rs in dims.items():
            ids, v = np.asarray([r.id for r in rs], np.int64), np.asarray([np.frombuffer(r.v, np.int64) for r in rs]).reshape(len(rs), d)
            packed[d] = (ids, v, np.asarray([np.frombuffer(r.pd, np.float64) for r in rs]) if d == common and rs[0].pd else None,
                         pivot_norm, starting_scores(ids, v, *drawn[d], k) if d in drawn else np.full(len(ids), -np.inf))
        sent = spark.sparkContext.broadcast(packed)
        part = staged(tab.mapInArrow(_search(sent, k), "query_id long, vec_id long, score long"), "block-best")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

