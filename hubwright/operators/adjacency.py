"""Edges as numbers, written by both ends, so that a walk never shuffles them.

``number_nodes`` gives the nodes of a label dense 64-bit numbers: ids are dealt to ranges and numbered within
each, and the ranges' sizes (one per task) say where each begins. ``build_adjacency`` turns edges into pairs of numbers
and writes them twice, bucketed and sorted by source and by target. A join on the bucketed end then brings the
frontier to the edges; the edges stay where they are.

A node with more than a ``MOST_HOT``-th of a table's edges (so at most ``MOST_HOT``) would make one bucket too long. Its edges are
dealt to several parts, and a frontier row of it goes to all of them. What is broadcast for that are those few nodes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from hubwright.operators.graph import DST, ID, SRC, EdgeKey, PropertyGraph
from hubwright.session import bucket_count, delete_folder, stage_table, staged_path

#: Edges per bucket, about. Fewer may be asked for, which holds while buckets are few (``session.bucket_count``).
BUCKET_EDGES = 1 << 22
#: Nodes of a table that may be hot, and the edges a node has at least to be.
MOST_HOT, LEAST_HOT = 1 << 10, 1 << 16
OUT, IN = "out", "in"
_ROW_BITS = 33  # monotonically_increasing_id: the task above, the row below


def number_nodes(frame: DataFrame) -> DataFrame:
    """``_id`` and ``node``: 0, 1, 2 … in order of ``_id``. Written once, so numbers do not change."""
    ranged = frame.select(ID).repartitionByRange(ID).sortWithinPartitions(ID)
    rows = stage_table(ranged.withColumn("_row", F.monotonically_increasing_id()))
    task = F.shiftrightunsigned("_row", _ROW_BITS)
    sizes = sorted(rows.groupBy(task.alias("_task")).count().collect())
    starts, total = [], 0
    for number, count in sizes:
        starts.append((number, total))
        total += count
    # one row per task of the numbering
    begin = F.broadcast(frame.sparkSession.createDataFrame(starts, "_task long, _begin long"))
    within = F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1)
    return rows.withColumn("_task", task).join(begin, "_task").select(ID, (F.col("_begin") + within).alias("node"))


@dataclass
class Adjacency:
    """Dictionaries by label; per edge table and direction a bucketed table (node, part, other) and its hot nodes (node, parts)."""

    spark: SparkSession
    dictionaries: dict[str, DataFrame] = field(default_factory=dict)
    tables: dict[tuple[EdgeKey, str], str] = field(default_factory=dict)
    hot: dict[tuple[EdgeKey, str], DataFrame] = field(default_factory=dict)
    folders: list[str] = field(default_factory=list)

    def step(self, frame: DataFrame, key: EdgeKey, direction: str, on: str, to: str) -> DataFrame:
        """One row per edge between a row's node (``on``, a number) and a neighbour (``to``)."""
        edges = self.spark.table(self.tables[key, direction]).withColumnRenamed("node", on).withColumnRenamed("other", to).withColumnRenamed("part", "_part")
        hot = self.hot[key, direction].withColumnRenamed("node", on)
        spread = frame.join(F.broadcast(hot), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return spread.join(edges, [on, "_part"]).drop("_part")

    def numbers(self, frame: DataFrame, label: str, on: str = ID, to: str = "node") -> DataFrame:
        return frame.join(self.dictionaries[label].select(F.col(ID).alias(on), F.col("node").alias(to)), on)

    def names(self, frame: DataFrame, label: str, on: str, to: str) -> DataFrame:
        """The ids of numbers, in their place."""
        return frame.join(self.dictionaries[label].select(F.col("node").alias(on), F.col(ID).alias(to)), on).drop(on)

    def drop(self) -> None:
        """Forget the tables and delete their files."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        for folder in self.folders:
            delete_folder(self.spark, folder)


def build_adjacency(graph: PropertyGraph, keys: Iterable[EdgeKey], bucket_edges: int = BUCKET_EDGES, least_hot: int = LEAST_HOT) -> Adjacency:
    """Number the nodes that the edge tables link and write each table by source and by target."""
    keys = list(keys)
    spark = next(iter(graph.nodes.values())).sparkSession
    made = Adjacency(spark)
    for label in sorted({end for key in keys for end in (key[0], key[2])}):
        made.dictionaries[label] = stage_table(number_nodes(graph.node(label)))
    for key in keys:
        edges = made.numbers(graph.edges[key].select(SRC, DST), key[0], SRC, "src")
        edges = stage_table(made.numbers(edges, key[2], DST, "dst").select("src", "dst"))
        total = edges.count()
        for direction, node, other in ((OUT, "src", "dst"), (IN, "dst", "src")):
            _write(made, key, direction, edges.select(F.col(node).alias("node"), F.col(other).alias("other")), total, bucket_edges, least_hot)
    return made


def _write(made: Adjacency, key: EdgeKey, direction: str, edges: DataFrame, total: int, bucket_edges: int, least_hot: int) -> None:
    limit = max(least_hot, total // MOST_HOT)
    counts = edges.groupBy("node").count().where(F.col("count") > limit)
    hot = stage_table(counts.select("node", F.ceil(F.col("count") / limit).cast("int").alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64("other"), F.col("parts")).cast("int"), F.lit(0))
    dealt = edges.join(F.broadcast(hot), "node", "left").select("node", part.alias("part"), "other")
    buckets, table, folder = bucket_count(total, bucket_edges, BUCKET_EDGES), f"adjacency_{uuid.uuid4().hex}", staged_path(made.spark)
    writer = dealt.repartition(buckets, "node", "part").write.format("parquet").option("path", folder)
    writer.bucketBy(buckets, "node", "part").sortBy("node", "part").saveAsTable(table)
    made.tables[key, direction], made.hot[key, direction] = table, hot
    made.folders.append(folder)


def two_hops(made: Adjacency, frame: DataFrame, first: tuple[EdgeKey, str], second: tuple[EdgeKey, str]) -> DataFrame:
    """``start_id``, ``end_id``: the distinct ends two steps away from the nodes of ``frame`` (``_id``)."""
    start, end = first[0][0 if first[1] == OUT else 2], second[0][2 if second[1] == OUT else 0]
    begun = made.numbers(frame.select(F.col(ID).alias("start_id")), start, "start_id", "start").select("start")
    met = made.step(begun, *first, "start", "middle").select("start", "middle").distinct()
    ends = made.step(met, *second, "middle", "end").select("start", "end").distinct()
    return made.names(made.names(ends, start, "start", "start_id"), end, "end", "end_id")
