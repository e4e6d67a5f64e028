"""A small cut of a graph for viewing: its best connected nodes and the edges among them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from hubwright.functions.values import property_entries, truncate_value
from hubwright.operators.graph import DST, ID, SRC, PropertyGraph, property_schema
from hubwright.operators.health import degrees
from hubwright.session import broadcast_if_small, cut_lineage

MAX_NODES = 400
MAX_EDGES = 1500
MAX_PROPERTIES = 8


def snapshot_nodes(graph: PropertyGraph, max_nodes: int = MAX_NODES) -> DataFrame:
    """Nodes of highest degree over all labels: ``label``, ``_id``, ``degree``."""
    return degrees(graph).orderBy(F.desc("degree"), "label", ID).limit(max_nodes)


def _edges_among(graph: PropertyGraph, kept: DataFrame) -> DataFrame:
    source = broadcast_if_small(kept.select(F.col("label").alias("from_label"), F.col(ID).alias(SRC)))
    target = broadcast_if_small(kept.select(F.col("label").alias("to_label"), F.col(ID).alias(DST)))
    return graph.all_edges().join(source, ["from_label", SRC], "left_semi").join(target, ["to_label", DST], "left_semi")


def snapshot_edges(graph: PropertyGraph, kept: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """Edges with both ends kept, the first ``max_edges`` by their ends. ``kept`` should be written first."""
    columns = ["from_label", SRC, "type", "to_label", DST]
    return _edges_among(graph, kept).select(*columns).orderBy(*columns).limit(max_edges)


def snapshot_legend(kept: DataFrame) -> DataFrame:
    """Kept nodes per label."""
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))


def snapshot_props(graph: PropertyGraph, kept: DataFrame, count: int = MAX_PROPERTIES) -> DataFrame:
    """The first few properties of each kept node, long values cut."""
    shown = []
    for label, frame in sorted(graph.nodes.items()):
        wanted = broadcast_if_small(kept.where(F.col("label") == label).select("label", ID, "degree"))
        entries = F.slice(property_entries(property_schema(frame)), 1, count)
        short = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), truncate_value(e["value"]).alias("value")))
        shown.append(frame.join(wanted, ID).select("label", ID, "degree", short.alias("props")))
    return reduce(DataFrame.unionByName, shown)


@dataclass(frozen=True)
class Snapshot:
    nodes: DataFrame
    links: DataFrame
    legend: DataFrame
    flags: DataFrame


def snapshot(graph: PropertyGraph, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> Snapshot:
    """The cut with its legend, totals, and a flag each for nodes and edges left out."""
    # written once instead of ranking all degrees for each use
    kept = cut_lineage(snapshot_nodes(graph, max_nodes))
    links = snapshot_edges(graph, kept, max_edges)
    total = graph.all_nodes().select(F.lit(1).alias("node"), F.lit(0).alias("edge"))
    among = _edges_among(graph, kept).select(F.lit(0).alias("node"), F.lit(1).alias("edge"))
    counted = total.unionByName(among).agg(F.sum("node").alias("total_nodes"), F.sum("edge").alias("edges_among"))
    flags = counted.select(
        "total_nodes",
        "edges_among",
        (F.col("total_nodes") > max_nodes).alias("nodes_sampled"),
        (F.col("edges_among") > max_edges).alias("edges_sampled"),
    )
    return Snapshot(snapshot_props(graph, kept), links, snapshot_legend(kept), flags)


def snapshot_sink(cut: Snapshot, path: str) -> None:
    """Write nodes, links, legend and flags as JSON lines under a folder."""
    for name in ("nodes", "links", "legend", "flags"):
        getattr(cut, name).write.mode("overwrite").json(f"{path}/{name}")
