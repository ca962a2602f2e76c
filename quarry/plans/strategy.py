"""Physical-strategy helpers shared by the operators.

``checked_broadcast`` is the only place a broadcast hint is added: the side
is counted and measured first and hinted only below a bound of rows and bytes; above it the plain join
is kept (sort-merge / shuffle-hash, re-planned by AQE at run time).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

# Rows of a side that may be broadcast without a further check.
DEFAULT_BROADCAST_ROWS = 2_000_000


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Compute ``df`` once and cut its lineage: it is written as a Parquet table
    into the shared folder named by ``spark.checkpoint.dir`` and read back, so
    that readers take the columns they need and nothing is held in memory.
    Survives executor loss without recomputing the lineage.

    The returned frame is the handle: callers pass it on where the same rows
    are needed again.  Nothing is remembered between calls, so a table that was
    overwritten in place is read anew.  The files stay until the folder is
    cleared after the job.  ``compression`` is a codec of Parquet, Spark's default if not given."""
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Bytes of a side that may be broadcast: its rows' own size, measured.
DEFAULT_BROADCAST_BYTES = 256 << 20


def _row_bytes(field, col):
    """Estimated bytes of one value of a column (an expression over the rows)."""
    t = field.dataType
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(t, T.ArrayType):
        if isinstance(t.elementType, T.StringType):
            return F.coalesce(F.octet_length(F.array_join(col, "")), F.lit(0)) + 16 * F.coalesce(F.size(col), F.lit(0)) + 16
        return 8 * F.greatest(F.coalesce(F.size(col), F.lit(0)), F.lit(0)) + 16
    if isinstance(t, (T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(col.alias("x")))), F.lit(0)) + 16
    return F.lit(16)


def _size(df: DataFrame) -> tuple[int, int]:
    """Rows and estimated bytes of a materialised table."""
    size = sum((_row_bytes(f, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(0)).cast("long")
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first())


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only when it has at most ``max_rows`` rows and about
    ``max_bytes`` bytes.

    The side is materialised first, so the check and the join that follows
    share one computation."""
    m = materialize(df)
    n, total = _size(m)
    return F.broadcast(m) if n <= max_rows and total <= max_bytes else m


# Rows and bytes of the frequent keys that are broadcast when a whole table of
# keys is too large for it.
FREQUENT_ROWS, FREQUENT_BYTES = 500_000, 64 << 20


def frequent_first(keyed: DataFrame, weight: Column, max_rows: int = FREQUENT_ROWS,
                   max_bytes: int = FREQUENT_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """A materialised table of one row per key, as (its keys of largest
    ``weight``, marked for broadcast; the others, or None if all fit).

    ``weight`` grows with the rows that meet a key.  Few keys have most of the
    rows, so most rows are joined where they are, and only those of rare keys
    are shuffled.  One number, the weight between the two, reaches the driver."""
    n, total = _size(keyed)
    if n <= max_rows and total <= max_bytes:
        return F.broadcast(keyed), None
    share = min(max_rows / n, max_bytes / total)
    cut = keyed.agg(F.percentile_approx(weight.cast("double"), F.lit(1.0 - share), F.lit(10_000))).first()[0]
    often = F.coalesce(weight > cut, F.lit(False))
    return F.broadcast(keyed.filter(often)), keyed.filter(~often)


def lookup(rows: DataFrame, keyed: DataFrame, key: str, max_rows: int = FREQUENT_ROWS,
           max_bytes: int = FREQUENT_BYTES) -> DataFrame:
    """Left join of many rows with a table ``keyed`` on their common column
    ``key``.  A table too large to broadcast is cut to the keys that the rows name
    and split by how often they do (``frequent_first``); rows whose key is not among the frequent ones are
    shuffled, the others stay in their task."""
    keyed = materialize(keyed)
    n, total = _size(keyed)
    if n <= max_rows and total <= max_bytes:
        return rows.join(F.broadcast(keyed), key, "left")
    met = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_met"))
    often, rare = frequent_first(materialize(keyed.join(met, key)), F.col("_met"), max_rows, max_bytes)
    if rare is None:
        return rows.join(often.drop("_met"), key, "left")
    near = rows.join(often.drop("_met"), key)
    far = rows.join(often.select(key), key, "left_anti").join(rare.drop("_met"), key, "left")
    return near.unionByName(far)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Input-split awareness: a scan with fewer partitions than the cluster
    can run at once (e.g. one large unsplittable file) is spread round-robin
    over ``min_partitions`` (default: the default parallelism) before per-row
    work.  With many input splits (the normal case at scale) it is a no-op."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def block_count(n_rows: int, block_rows: int) -> int:
    """Number of blocks so that each holds about ``block_rows`` rows."""
    return max(1, math.ceil(n_rows / max(1, block_rows)))


def global_rank(df: DataFrame, order_cols: list, name: str = "rank") -> DataFrame:
    """Dense 1..N row numbers in a global order without a single-partition
    window: range-partitioned sort, per-partition counts (one row per
    partition), cumulative offsets, then offset + position in partition."""
    s = df.orderBy(*order_cols)
    s = s.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    # materialise once: the counts and the rows must see the same partitioning
    s = materialize(s)
    # monotonically_increasing_id = (partition << 33) + index within partition
    s = s.withColumn("_idx", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per sort partition (bounded by the partition count)
    out = s.join(F.broadcast(offs), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_idx") + 1).cast("long")) \
        .drop("_pid", "_mid", "_idx", "_off")

