"""Reachability without listing paths: which nodes can be reached, and in how few hops.

Distances double. After a round all pairs at most ``2 ** k`` hops apart are known, each with its fewest hops. A pair
up to twice as far apart has a node exactly ``2 ** k`` hops from its start on a shortest path, so the pairs at that very
distance, joined with everything known, give the next layer; pairs known before are taken out. So rounds
grow with the logarithm of the greatest distance, and cycles end by themselves, as no distance is unbounded.

Where every node has one edge out at most, as in a hierarchy, the pairs at ``2 ** k`` hops are jump pointers and each
pair is made once. What is returned is as large as the closure itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hubwright.operators.graph import ID, PropertyGraph
from hubwright.operators.match import oriented
from hubwright.session import stage_table


def reachable(
    graph: PropertyGraph, rel_type: str, direction: str = "out", from_label: str | None = None, to_label: str | None = None
) -> DataFrame:
    """``start_id``, ``end_id``, ``hops``: every pair of nodes with a path of that type, and its fewest hops (at least 1).

    A node on a cycle reaches itself. There is no bound on the length.
    """
    key = graph.edge_keys(rel_type, from_label, to_label)[0]
    if key[0] != key[2]:
        raise ValueError(f"paths of one type need edges within one label, not {key[0]} to {key[2]}")
    steps = oriented(graph.edge(rel_type, from_label, to_label), direction, "start_id", "end_id").select("start_id", "end_id").distinct()
    known = layer = stage_table(steps.withColumn("hops", F.lit(1)))
    reach = 1
    while True:
        # the pairs at exactly `reach` hops; the layers before are nearer
        far = layer.where(F.col("hops") == reach).select("start_id", F.col("end_id").alias("middle"))
        onward = known.select(F.col("start_id").alias("middle"), "end_id", (F.col("hops") + reach).alias("hops"))
        # several middles agree on the fewest hops of a new pair, so copies are reduced in the tasks
        met = far.join(onward, "middle").groupBy("start_id", "end_id").agg(F.min("hops").alias("hops"))
        layer = stage_table(met.join(known.select("start_id", "end_id"), ["start_id", "end_id"], "left_anti"))
        if layer.isEmpty():
            return known
        known, reach = known.unionByName(layer), 2 * reach


def closure_from(
    graph: PropertyGraph, frame: DataFrame, rel_type: str, direction: str = "out", from_label: str | None = None, to_label: str | None = None
) -> DataFrame:
    """``start_id``, ``end_id``, ``hops`` for the nodes of a frame alone (0 hops to themselves): one round per hop, each from
    the pairs that are new, so what other nodes reach is not worked out."""
    steps = stage_table(oriented(graph.edge(rel_type, from_label, to_label), direction, "end_id", "next_id").select("end_id", "next_id").distinct())
    known = new = stage_table(frame.select(F.col(ID).alias("start_id"), F.col(ID).alias("end_id"), F.lit(0).alias("hops")).distinct())
    hop = 0
    while True:
        hop += 1
        met = new.join(steps, "end_id").select("start_id", F.col("next_id").alias("end_id")).distinct()
        new = stage_table(met.join(known.select("start_id", "end_id"), ["start_id", "end_id"], "left_anti").withColumn("hops", F.lit(hop)))
        if new.isEmpty():
            return known
        known = known.unionByName(new)
