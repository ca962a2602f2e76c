"""Connected components of a large edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; the component is the
    smallest node that can be reached.

    Each round hangs, for every node, its larger neighbours on the smallest
    one and then its smaller neighbours likewise; rounds grow with the
    logarithm of the longest path.  A round is aggregations and equi-joins, so
    a node with very many neighbours is pre-aggregated and its join split."""
    e = staged(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct(), "edges")
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select("m", "v").distinct()
        low = large.groupBy("v").agg(F.min("m").alias("u"))
        small = large.join(low, "v")
        e = staged(small.select("u", "v").unionByName(small.filter("m > u").select("u", F.col("m").alias("v")))
                   .distinct(), "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
                e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
        before = now
