"""Verification by a tree of digests: only ranges that differ are compared by key.

Keys of source and graph are hashed, and the first bits of the hash are a path in a tree. A node of the tree holds what the
two sides do not have in common in its range: the difference of their counts, the xor of all digests, and the difference
of the digests' sums. All three ignore order and are reduced in each task, so a level costs one aggregate of
at most ``2 ** LEVEL_BITS`` rows per task and opened node, and no key is shuffled. If every node of the first level is zero, the sides are equal.
Otherwise nodes that differ are opened level by level, and what is left in the last ones is compared by key.

Equal sets never differ. Two different sets of one range look equal only if count, 64-bit xor and sum of the digests all agree.
Repeated keys of the source make a range differ, as do keys on one side; the comparison by key then settles it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hubwright.operators.graph import PropertyGraph
from hubwright.operators.verify import graph_keys, source_keys
from hubwright.plans.model import Model
from hubwright.session import stage_table

#: Bits by which a level opens a node.
LEVEL_BITS = 10
#: Nodes that differ and are opened further at most; beyond that their ranges are compared by key at once.
MOST_OPENED = 1 << 10
#: Rows in a node that differs, on average, that are compared by key without opening it further.
LEAF_ROWS = 1 << 12

SCHEMA = "depth int, nodes bigint, differing bigint, rows bigint"


def _path(depth: int) -> Column:
    return F.shiftrightunsigned("_place", 64 - depth)


def _hashed(df: DataFrame, graph: PropertyGraph, model: Model) -> tuple[DataFrame, list[str]]:
    """Keys of both sides with their side (1, -1), place in the tree and digest; keys with a missing part make no node."""
    source, built = source_keys(df, model), graph_keys(graph, model)
    keys = source.columns
    sides = source.withColumn("_side", F.lit(1)).unionByName(built.withColumn("_side", F.lit(-1))).dropna(subset=keys)
    # two hashes, so that where a key lies says nothing about its digest
    return sides.withColumn("_place", F.xxhash64(*keys)).withColumn("_digest", F.xxhash64(F.lit(1), *keys)), keys


def _level(sides: DataFrame, depth: int) -> DataFrame:
    """path, rows, differs of each node of a level that holds a key."""
    # 24 bits of the digest: their sum fits as long as a node has fewer than 2^39 rows
    part = F.shiftrightunsigned("_digest", 40)
    nodes = sides.groupBy(_path(depth).alias("path")).agg(
        F.sum("_side").alias("count"), F.bit_xor("_digest").alias("xor"), F.sum(F.col("_side") * part).alias("sum"), F.count(F.lit(1)).alias("rows")
    )
    return nodes.select("path", "rows", ((F.col("count") != 0) | (F.col("xor") != 0) | (F.col("sum") != 0)).alias("differs"))


@dataclass(frozen=True)
class Comparison:
    """``levels``: (depth, nodes, differing, rows) of each level that was looked at. ``differences``: the keys and ``side``,
    which is ``missing`` (in the source alone) or ``surplus`` (in the graph alone)."""

    levels: list[tuple[int, int, int, int]]
    differences: DataFrame

    @property
    def equal(self) -> bool:
        return not self.levels[-1][2]

    def level_rows(self) -> DataFrame:
        return self.differences.sparkSession.createDataFrame(self.levels, SCHEMA)


def compare(
    df: DataFrame, graph: PropertyGraph, model: Model, level_bits: int = LEVEL_BITS, most_opened: int = MOST_OPENED, leaf_rows: int = LEAF_ROWS
) -> Comparison:
    """Which keys of a table a graph lacks, and which it has beyond it."""
    sides, keys = _hashed(df, graph, model)
    levels, open_, depth = [], sides, level_bits
    while True:
        nodes = stage_table(_level(open_, depth))
        found = nodes.agg(F.count(F.lit(1)), F.count_if("differs"), F.coalesce(F.sum(F.when(F.col("differs"), F.col("rows"))), F.lit(0))).first()
        levels.append((depth, *found))
        _, differing, rows = found
        # at most 2^level_bits nodes on the first level and most_opened * 2^level_bits on a later one, 8 bytes each
        wanted = F.broadcast(nodes.where("differs").select(F.col("path").alias("_path")))
        ranges = sides.withColumn("_path", _path(depth)).join(wanted, "_path", "left_semi").drop("_path")
        if differing == 0 or differing > most_opened or rows <= leaf_rows * differing or depth + level_bits > 64:
            break
        open_, depth = ranges, depth + level_bits
    tally = ranges.groupBy(*keys).agg(F.max("_side").alias("most"), F.min("_side").alias("least"))
    side = F.when(F.col("most") < 0, "surplus").when(F.col("least") > 0, "missing")
    return Comparison(levels, tally.withColumn("side", side).where("side is not null").select(*keys, "side"))
