"""Sharding by a hierarchical weighted hash tree.

A tree has three levels, regions, racks and shards.  Every shard has a weight;
a rack weighs what its shards weigh together and a region what its racks weigh.
A key descends level by level.  At each node every child draws

    -ln(u) / weight,   u in (0, 1) from the hash of the key and the child's name

and the smallest draw wins, so a child gets its share of the weight.  A child's
draw depends on the key, its own name and its own weight alone: where two paths
of a key part, one of the two children there has another weight than before.
So keys move only into, out of, or inside subtrees whose weights change, and the
rest of the tree never moves.  ``Tree.grown`` adds a shard as a region of its
own: no other weight changes, hence the new shard takes keys only into itself.

Draws are DataFrame functions; a row costs one hash per child on its path and
no shuffle.  Slots number the rows of a shard without gaps: tasks number their
own rows, and prefix sums over (task, shard) counts place them.

Defined results: a null text has no bytes (size 16, crc32 0), as an empty one;
long texts are measured whole, in the JVM, and never leave it; rows that repeat
a key go to one shard, each to a slot of its own; rows with a null key are one
key; ties of draws go to the smaller node number; shards of weight 0 take
nothing; an empty table gives no rows; other columns are ignored by ``assign``
and kept by ``write_shards``.  Slots follow the order in which the rows are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, free_name, staged

EXTRA_BYTES = 16   # added to every row's size


@dataclass(frozen=True)
class Shard:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    """The shards of a tree; shard numbers, and rack names within a region, are unique."""
    shards: tuple[Shard, ...]

    def __post_init__(self):
        if len({s.shard for s in self.shards}) != len(self.shards):
            raise ValueError("shard numbers must be unique")
        if not self.shards or any(not 0 <= s.weight < float("inf") for s in self.shards) \
                or not any(s.weight for s in self.shards):
            raise ValueError("weights must be finite and not negative, and one of them positive")

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, numbered next, which is a region of its own."""
        n = max(s.shard for s in self.shards) + 1
        names = {s.region for s in self.shards}
        region = f"region-of-{n}"
        while region in names:
            region += "+"
        return Tree(self.shards + (Shard(n, region, "rack-0", weight),))

    def reweighted(self, weights: dict[int, float]) -> Tree:
        return Tree(tuple(Shard(s.shard, s.region, s.rack, weights.get(s.shard, s.weight)) for s in self.shards))


def uniform(n: int, racks: int = 2, per_rack: int = 4) -> Tree:
    """``n`` shards of weight 1 in regions of ``racks`` racks of ``per_rack`` shards."""
    whole = racks * per_rack
    return Tree(tuple(Shard(i, f"region-{i // whole}", f"rack-{i % whole // per_rack}") for i in range(n)))


def _children(tree: Tree) -> list[list[list[tuple[str, int, float]]]]:
    """Per level, per node: the children (name, number, weight) that weigh something.
    Numbers count the nodes of a level; on the last level they are the shards."""
    regions: dict[str, dict[str, list[Shard]]] = {}
    for s in sorted(tree.shards, key=lambda s: s.shard):
        if s.weight > 0:
            regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    top, middle, low = [], [], []
    for g, (region, racks) in enumerate(regions.items()):
        middle.append([])
        for rack, shards in racks.items():
            middle[g].append((f"{region}/{rack}", len(low), sum(s.weight for s in shards)))
            low.append([(f"{region}/{rack}/{s.shard}", s.shard, s.weight) for s in shards])
        top.append((region, g, sum(w for _, _, w in middle[g])))
    return [[top], middle, low]


def _uniform_draw(key: Column, name: Column) -> Column:
    """A number in (0, 1): the middle of one of 2^52 equal parts."""
    part = F.shiftrightunsigned(F.xxhash64(key, name), 12).cast("double")
    return (part + 0.5) / F.lit(2.0 ** 52)


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard (int) of a key."""
    node = F.lit(0)
    for level in _children(tree):
        table = F.array(*[F.array(*[F.struct(F.lit(name).alias("name"), F.lit(number).alias("number"),
                                             F.lit(float(weight)).alias("weight")) for name, number, weight in kids])
                          for kids in level])
        draws = F.transform(F.get(table, node), lambda c: F.struct(
            (-F.log(_uniform_draw(key, c["name"])) / c["weight"]).alias("draw"), c["number"].alias("number")))
        node = F.array_min(draws)["number"]
    return node.cast("int")


def _numbered(n_columns: int, at: int):
    """Appends the task's number and, per value of column ``at``, the row's
    number within the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            shard = b.column(at).to_numpy()
            order = np.argsort(shard, kind="stable")
            values, first, count = np.unique(shard[order], return_index=True, return_counts=True)
            no = np.empty(len(shard), np.int64)
            for v, f, c in zip(values.tolist(), first.tolist(), count.tolist()):
                no[order[f:f + c]] = np.arange(seen.get(v, 0), seen.get(v, 0) + c)
                seen[v] = seen.get(v, 0) + c
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(n_columns)), pa.array(np.full(len(shard), task, np.int32)), pa.array(no)],
                names=[*b.schema.names[:n_columns], "task", "no"])
    return run


def assign(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law (``key``), shard,
    slot (from 0 in each shard), grown_shard (its shard once the tree has grown
    by one)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col("doc_id")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + EXTRA_BYTES).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.select("doc_id", "size", "text_crc32", shard_of(key, tree).alias("shard"),
                       shard_of(key, tree.grown()).alias("grown_shard"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, size long, text_crc32 long, shard int, grown_shard int, task int, no long"
    rows = staged(rows.mapInArrow(_numbered(5, 3), ddl), "numbered")
    # one row per (task, shard)
    counts = rows.groupBy("shard", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = bounded(staged(counts.select("shard", "task", F.coalesce(before, F.lit(0)).alias("start")), "slot-starts"))
    return rows.join(starts, ["shard", "task"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("no")).alias("slot"),
        "grown_shard")


def write_shards(docs: DataFrame, tree: Tree, folder: str, id_col: str = "doc_id") -> None:
    """Write all rows and columns of ``docs`` under ``folder``, one folder
    ``<column>=<shard>`` per shard; the column is ``shard``, or a longer name
    where the rows have one of that name.  Tasks write straight into the shards
    they meet, without a shuffle."""
    name = free_name(docs, "shard")
    docs.withColumn(name, shard_of(docs[id_col], tree)).write.partitionBy(name).parquet(folder)


def moves(docs: DataFrame, before: Tree, after: Tree, id_col: str = "doc_id") -> DataFrame:
    """shard_before, shard_after, n: the rows that a change of tree moves."""
    b, a = shard_of(docs[id_col], before), shard_of(docs[id_col], after)
    return docs.select(b.alias("shard_before"), a.alias("shard_after")).filter("shard_before <> shard_after") \
        .groupBy("shard_before", "shard_after").agg(F.count(F.lit(1)).alias("n"))
