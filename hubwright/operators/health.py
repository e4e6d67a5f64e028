"""Health report of a graph: degrees, hubs, orphans, property shapes, findings."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from hubwright.functions.values import ident_list, property_keys
from hubwright.operators.digest import HUB_NODES, label_counts, rel_type_counts
from hubwright.operators.graph import DST, ID, SRC, PropertyGraph, property_names, property_schema
from hubwright.session import BROADCAST_ROWS, stage_table
from hubwright.sources.tables import TableSpec

TOP_HUBS = 5
SUPERNODE_DEGREE = 100_000
BIG_LABEL = 1000

# Names that say nothing about what they connect.
GENERIC_NAMES = (
    "Entity", "Node", "Item", "Object", "Data",
    "RELATED_TO", "CONNECTED_TO", "HAS", "REL",
)


def degrees(graph: PropertyGraph) -> DataFrame:
    """Edges at each node in either direction, a self-loop once, unlinked nodes 0.

    Nodes (weight 0) and edge ends (weight 1) go through one aggregation that is
    reduced inside each task first, so there is one shuffle, no join and no hot
    key. Both ends come out of one scan of each edge table.
    """
    nodes = graph.all_nodes().select("label", ID, F.lit(0).alias("weight"), F.lit(True).alias("node"))
    loop = (F.col("from_label") == F.col("to_label")) & (F.col(SRC) == F.col(DST))
    source = F.struct(F.col("from_label").alias("label"), F.col(SRC).alias(ID))
    target = F.struct(F.col("to_label").alias("label"), F.col(DST).alias(ID))
    ends = graph.all_edges().select(F.inline(F.when(loop, F.array(source)).otherwise(F.array(source, target))))
    everything = nodes.unionByName(ends.select("label", ID, F.lit(1).alias("weight"), F.lit(False).alias("node")))
    return (
        everything.groupBy("label", ID)
        .agg(F.sum("weight").alias("degree"), F.max("node").alias("node"))
        .where("node")
        .drop("node")
    )


def _degrees(graph: PropertyGraph, known: DataFrame | None) -> DataFrame:
    """Degrees that were written before, for reports of several parts, or else a plan for them."""
    return degrees(graph) if known is None else known


def guarded(graph: PropertyGraph, max_nodes: int | None = None) -> tuple[PropertyGraph, DataFrame]:
    """Labels whose degrees to report, and the labels left out for having more nodes than ``max_nodes``.

    Degrees cost one shuffle here, so by default nothing is left out.
    """
    counts = label_counts(graph)
    if max_nodes is None:
        return graph, counts.limit(0)
    skipped = counts.where(F.col("count") > max_nodes)
    names = {row["label"] for row in skipped.collect()}
    return PropertyGraph({k: v for k, v in graph.nodes.items() if k not in names}, graph.edges), skipped


def top_degrees(graph: PropertyGraph, k: int = TOP_HUBS, known: DataFrame | None = None) -> DataFrame:
    """The k nodes of highest degree per label; tasks keep k rows per label before the shuffle."""
    order = Window.partitionBy("label").orderBy(F.desc("degree"), ID)
    return _degrees(graph, known).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_hubs(graph: PropertyGraph, k: int = TOP_HUBS, known: DataFrame | None = None) -> DataFrame:
    """``top_degrees`` with what identifies each node."""
    # k rows per label, written once: each label's look-up would plan all degrees anew
    best = stage_table(top_degrees(graph, k, known))
    named = []
    for label, frame in sorted(graph.nodes.items()):
        wanted = best.where(F.col("label") == label)
        if k <= BROADCAST_ROWS:  # the frame has at most k rows
            wanted = F.broadcast(wanted)
        idents = frame.select(ID, ident_list(property_schema(frame)).alias("ident"))
        named.append(idents.join(wanted, ID).select("label", "rank", ID, "degree", "ident"))
    return reduce(DataFrame.unionByName, named)


def orphans(graph: PropertyGraph, known: DataFrame | None = None) -> DataFrame:
    """Nodes without any edge, per label."""
    return _degrees(graph, known).groupBy("label").agg(F.count_if(F.col("degree") == 0).alias("orphans"))


def orphan_source_rows(spec: TableSpec, columns: Iterable[str]) -> DataFrame:
    """Source rows that come out unlinked because all their link columns are NULL."""
    unlinked = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNull() for c in columns])
    return spec.df.where(unlinked)


def _shape_counts(graph: PropertyGraph) -> DataFrame:
    shapes = [
        frame.groupBy(property_keys(property_names(frame)).alias("shape"))
        .agg(F.count(F.lit(1)).alias("nodes"))
        .select(F.lit(label).alias("label"), "shape", "nodes")
        for label, frame in sorted(graph.nodes.items())
    ]
    return reduce(DataFrame.unionByName, shapes)


def maximal_shapes(graph: PropertyGraph) -> DataFrame:
    """Property sets under each label; one that is part of another counts for that one.

    NULL columns and key-only nodes make such part shapes. Shapes are far fewer
    than nodes. Candidates for "is part of" come from an equal-key join: whatever
    holds a shape also holds the rarest of its properties, the one that fewest shapes have.
    """
    shapes = stage_table(_shape_counts(graph))
    holders = shapes.select(
        "label", F.col("shape").alias("holder"), F.explode(F.col("shape")).alias("first")
    )
    uses = holders.groupBy("label", "first").agg(F.count(F.lit(1)).alias("uses"))
    rarest = (
        holders.join(uses, ["label", "first"])
        .groupBy("label", F.col("holder").alias("shape"))
        .agg(F.min(F.struct("uses", "first")).alias("rarest"))
        .select("label", "shape", F.col("rarest.first").alias("first"))
    )
    # a node without any property is part of the largest shape, if there is another
    whole = shapes.groupBy("label").agg(F.min(F.struct((-F.size("shape")).alias("size"), F.col("shape").alias("holder"))).alias("largest"))
    empty = shapes.where(F.size("shape") == 0).select("label", "shape", "nodes").join(whole.select("label", "largest.holder"), "label")
    parts = shapes.join(rarest, ["label", "shape"])
    held = parts.join(holders, ["label", "first"]).select("label", "shape", "holder").unionByName(empty.select("label", "shape", "holder")).where(
        (F.size("holder") > F.size("shape")) & (F.size(F.array_except("shape", "holder")) == 0)
    )
    # the largest holder is maximal itself; equal sizes go by name
    best = held.groupBy("label", "shape").agg(F.min(F.struct((-F.size("holder")).alias("size"), "holder")).alias("best"))
    folded = shapes.join(best, ["label", "shape"], "left").select(
        "label", F.coalesce(F.col("best.holder"), F.col("shape")).alias("shape"), "nodes"
    )
    return folded.groupBy("label", "shape").agg(F.sum("nodes").alias("nodes"))


def key_shapes(graph: PropertyGraph, k: int | None = None) -> DataFrame:
    """The maximal shapes per label, or the k most frequent ones."""
    if k is None:
        return maximal_shapes(graph).select("label", "shape", "nodes")
    order = Window.partitionBy("label").orderBy(F.desc("nodes"), "shape")
    ranked = maximal_shapes(graph).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("label", "shape", "nodes")


def mixed_key_shapes(graph: PropertyGraph) -> DataFrame:
    """Labels under which shapes remain that do not contain each other: as a rule two loads that collide."""
    return (
        maximal_shapes(graph)
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("shapes"), F.sum("nodes").alias("nodes"))
        .where(F.col("shapes") > 1)
    )


def generic_names(graph: PropertyGraph, names: Iterable[str] = GENERIC_NAMES) -> DataFrame:
    """Labels and edge types with a name from the list."""
    used = label_counts(graph).select(F.lit("label").alias("kind"), F.col("label").alias("name"), "count").unionByName(
        rel_type_counts(graph).select(F.lit("type").alias("kind"), F.col("type").alias("name"), "count")
    )
    return used.where(F.col("name").isin(list(names)))


def missing_key_check(graph: PropertyGraph, declared: Iterable[str] = (), above: int = BIG_LABEL) -> DataFrame:
    """Labels of more than ``above`` nodes whose key is not declared, or not unique."""
    copies = graph.all_nodes().groupBy("label", ID).agg(F.count(F.lit(1)).alias("copies"))
    per_label = copies.groupBy("label").agg(
        F.sum("copies").alias("nodes"), F.count_if(F.col("copies") > 1).alias("repeated_keys")
    )
    known = F.col("label").isin(list(declared)) if list(declared) else F.lit(False)
    return (
        per_label.withColumn("declared", known)
        .where((F.col("nodes") > above) & (~F.col("declared") | (F.col("repeated_keys") > 0)))
        .select("label", "nodes", "declared", "repeated_keys")
    )


def supernodes(
    graph: PropertyGraph, degree: int = SUPERNODE_DEGREE, max_nodes: int = HUB_NODES, known: DataFrame | None = None
) -> DataFrame:
    """Few-node labels with a hub so connected that it should rather be a label of its own."""
    per_label = _degrees(graph, known).groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.max("degree").alias("top_degree"))
    return per_label.where((F.col("nodes") <= max_nodes) & (F.col("top_degree") > degree))


def degree_concentration(graph: PropertyGraph, k: int = TOP_HUBS, known: DataFrame | None = None) -> DataFrame:
    """Share of a label's edge ends that its k best connected nodes hold."""
    known = stage_table(degrees(graph)) if known is None else known
    every = known.groupBy("label").agg(F.sum("degree").alias("all_ends"))
    top = top_degrees(graph, k, known).groupBy("label").agg(F.sum("degree").alias("top_ends"))
    return every.join(top, "label").where(F.col("all_ends") > 0).select(
        "label", "top_ends", "all_ends", F.round(F.col("top_ends") / F.col("all_ends"), 4).alias("share")
    )


def health(graph: PropertyGraph, declared: Iterable[str] = (), max_nodes: int | None = None) -> dict[str, DataFrame]:
    """The whole report. Degrees are written once, as four parts read them; the parts themselves are lazy."""
    scanned, skipped = guarded(graph, max_nodes)
    known = stage_table(degrees(scanned))
    return {
        "labels": label_counts(graph).orderBy(F.desc("count"), "label"),
        "relationship_types": rel_type_counts(graph).orderBy(F.desc("count"), "type"),
        "key_shapes": key_shapes(graph),
        "top_hubs": top_hubs(scanned, known=known),
        "orphans": orphans(scanned, known),
        "degree_scan_skipped": skipped,
        "generic_names": generic_names(graph),
        "mixed_key_shapes": mixed_key_shapes(graph),
        "missing_keys": missing_key_check(graph, declared),
        "supernodes": supernodes(scanned, known=known),
        "degree_concentration": degree_concentration(scanned, known=known),
    }
