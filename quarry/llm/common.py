"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    read it back: the lineage is cut, and a lost executor costs a re-read only."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of a narrow staged table (an id or two) that may be broadcast.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a staged table of narrow rows for broadcast when its count allows;
    else the join shuffles, and Spark splits its skewed partitions."""
    return F.broadcast(df) if df.count() <= rows else df


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, one row per key whose column ``n`` says
    how many rows share it.  Keys of very many rows are broadcast, so that their
    rows stay where they are; there are at most ``BROADCAST_ROWS`` of them
    however large the table is, as each stands for that share of its rows.  The
    others are shuffled.  Both tables must be staged: they are read twice."""
    total, most = keyed.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    limit = max(1000, -(-total // BROADCAST_ROWS))
    cold = keyed.filter(F.col(n) < limit).drop(n)
    if most < limit:
        return rows.join(cold, on, how)
    hot = F.broadcast(keyed.filter(F.col(n) >= limit).drop(n))
    rest = rows.join(hot.select(*on), on, "left_anti").join(cold, on, how)
    return rows.join(hot, on).unionByName(rest)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as '')."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unique_name(prefix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex}"
