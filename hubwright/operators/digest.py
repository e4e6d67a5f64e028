"""What a graph holds right now: labels, counts, properties, patterns, fingerprint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from hubwright.functions.values import to_text
from hubwright.operators.graph import PropertyGraph, property_names

HUB_NODES = 50


def label_counts(graph: PropertyGraph) -> DataFrame:
    """Nodes per label. Counts come from each table's own metadata-sized scan, empty labels included."""
    counts = [
        frame.agg(F.count(F.lit(1)).alias("count")).select(F.lit(label).alias("label"), "count")
        for label, frame in sorted(graph.nodes.items())
    ]
    return reduce(DataFrame.unionByName, counts).orderBy("label")


def pattern_counts(graph: PropertyGraph) -> DataFrame:
    counts = [
        frame.agg(F.count(F.lit(1)).alias("count")).select(
            F.lit(source).alias("from"), F.lit(rel_type).alias("type"), F.lit(target).alias("to"), "count"
        )
        for (source, rel_type, target), frame in sorted(graph.edges.items())
    ]
    return reduce(DataFrame.unionByName, counts).where(F.col("count") > 0)


def rel_type_counts(graph: PropertyGraph) -> DataFrame:
    """Edges per type."""
    return pattern_counts(graph).groupBy("type").agg(F.sum("count").alias("count")).orderBy("type")


def patterns(graph: PropertyGraph) -> DataFrame:
    """(from, type, to, count), most frequent first. Metadata, so all of them."""
    return pattern_counts(graph).orderBy(F.desc("count"), "from", "type", "to")


def label_properties(graph: PropertyGraph) -> DataFrame:
    """Names of the properties that at least one node of a label has. One scan per label, no sample."""
    found = []
    for label, frame in sorted(graph.nodes.items()):
        names = sorted(property_names(frame))
        used = frame.agg(*[F.max(F.col(f"`{n}`").isNotNull()).alias(f"p{i}") for i, n in enumerate(names)])
        listed = F.array_compact(F.array(*[F.when(F.col(f"p{i}"), F.lit(n)) for i, n in enumerate(names)]))
        found.append(used.select(F.lit(label).alias("label"), listed.alias("properties")))
    return reduce(DataFrame.unionByName, found)


def dimension_values(graph: PropertyGraph, max_nodes: int = HUB_NODES) -> DataFrame:
    """Sorted values of every label with at most ``max_nodes`` nodes.

    One node more than that is fetched per label: if it is there, the label is
    too large, and no larger array is ever collected.
    """
    hubs = [(label, frame) for label, frame in sorted(graph.nodes.items()) if "value" in frame.columns]
    if not hubs:
        spark = next(iter(graph.nodes.values())).sparkSession
        return spark.createDataFrame([], "label string, values array<string>")
    found = []
    for label, frame in hubs:
        value = to_text(F.col("value"), frame.schema["value"].dataType).alias("value")
        first = frame.select(value).limit(max_nodes + 1)
        listed = first.agg(F.count(F.lit(1)).alias("nodes"), F.array_sort(F.collect_list("value")).alias("values"))
        small = (F.col("nodes") <= max_nodes) & (F.size("values") > 0)
        found.append(listed.where(small).select(F.lit(label).alias("label"), "values"))
    return reduce(DataFrame.unionByName, found)


def fingerprint(graph: PropertyGraph) -> DataFrame:
    """Sixteen hex digits that change whenever the count of a label does."""
    entry = F.struct("label", F.concat_ws(":", "label", F.col("count").cast("string")).alias("text"))
    listed = label_counts(graph).where(F.col("count") > 0).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    joined = F.array_join(F.transform("entries", lambda e: e["text"]), "|")
    return listed.select(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


def digest(graph: PropertyGraph) -> dict[str, DataFrame]:
    return {
        "labels": label_counts(graph),
        "relationships": rel_type_counts(graph),
        "patterns": patterns(graph),
        "properties": label_properties(graph),
        "dimension_values": dimension_values(graph),
        "fingerprint": fingerprint(graph),
    }
