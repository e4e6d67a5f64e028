"""Degrees and pattern counts that are kept up by what changes.

An upsert removes and adds edges. ``edge_changes`` says which, as signed rows; they are worked out from the edges of the upserted rows alone.
``apply_to_degrees`` and ``apply_to_patterns`` fold them into stored counts, without reading any other edge.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from hubwright.operators.build import build_graph
from hubwright.operators.graph import DST, EDGE_ENDS, ID, SRC, EdgeKey, PropertyGraph
from hubwright.plans.model import JoinModel, Model
from hubwright.sources.tables import TableSpec


@dataclass
class Changes:
    """New nodes by label, and signed edges by table: +1 for one that is new, -1 for one that goes."""

    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[EdgeKey, DataFrame] = field(default_factory=dict)


def edge_changes(old: DataFrame, new: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """``src_id``, ``dst_id``, ``sign`` of what merging ``new`` into ``old`` changes. ``touched``: sources whose old edges go.

    The old table is cut down to the sources or ends that arrived by a semi join, which a small delta turns into a filter of its scan.
    """
    ends = list(EDGE_ENDS)
    if touched is None:
        known = old.select(*ends).join(new.select(*ends), ends, "left_semi")
        return new.select(*ends).distinct().join(known, ends, "left_anti").withColumn("sign", F.lit(1))
    before = old.select(*ends).join(touched.select(F.col(ID).alias(SRC)), SRC, "left_semi").withColumn("sign", F.lit(-1))
    after = new.select(*ends).distinct().withColumn("sign", F.lit(1))
    signed = before.unionByName(after).groupBy(*ends).agg(F.sum("sign").cast("int").alias("sign"))
    return signed.where("sign != 0")


def node_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The ids that are new."""
    known = old.select(ID).join(new.select(ID), ID, "left_semi")
    return new.select(ID).distinct().join(known, ID, "left_anti")


def load_changes(graph: PropertyGraph, spec: TableSpec, model: Model, replace_for_upserted: bool = True) -> Changes:
    """What merging the rows of ``spec`` into ``graph`` changes (see ``streaming.sync.merge_load``)."""
    fresh = build_graph([(spec, model)])
    found = Changes()
    for label, frame in fresh.nodes.items():
        found.nodes[label] = node_changes(graph.nodes[label], frame) if label in graph.nodes else frame.select(ID)
    touched = None
    if replace_for_upserted and not isinstance(model, JoinModel):
        # the rows that were loaded, without the nodes that they refer to
        touched = build_graph([(spec, replace(model, relationships=()))]).nodes[model.label].select(ID)
    for key, frame in fresh.edges.items():
        if key in graph.edges:
            found.edges[key] = edge_changes(graph.edges[key], frame, touched)
        else:
            found.edges[key] = frame.select(*EDGE_ENDS).distinct().withColumn("sign", F.lit(1))
    return found


def _ends(key: EdgeKey, signed: DataFrame) -> DataFrame:
    """Each changed edge at both its nodes, a self-loop once."""
    source = F.struct(F.lit(key[0]).alias("label"), F.col(SRC).alias(ID))
    target = F.struct(F.lit(key[2]).alias("label"), F.col(DST).alias(ID))
    loop = F.lit(key[0] == key[2]) & (F.col(SRC) == F.col(DST))
    return signed.select(F.explode(F.when(loop, F.array(source)).otherwise(F.array(source, target))).alias("end"), "sign").select(
        "end.*", F.col("sign").cast("bigint").alias("degree")
    )


def apply_to_degrees(stored: DataFrame, changes: Changes) -> DataFrame:
    """The degrees (label, _id, degree) after the changes: one shuffle of stored counts, no edge is read."""
    new = [frame.select(F.lit(label).alias("label"), ID, F.lit(0).cast("bigint").alias("degree")) for label, frame in changes.nodes.items()]
    moved = [_ends(key, signed) for key, signed in changes.edges.items()]
    whole = reduce(DataFrame.unionByName, [stored.select("label", ID, F.col("degree").cast("bigint").alias("degree")), *new, *moved])
    return whole.groupBy("label", ID).agg(F.sum("degree").alias("degree"))


def pattern_changes(changes: Changes) -> DataFrame:
    """from, type, to, count: what each pattern's count grows by."""
    parts: Iterable[DataFrame] = [
        signed.agg(F.coalesce(F.sum("sign"), F.lit(0)).cast("bigint").alias("count")).select(
            F.lit(key[0]).alias("from"), F.lit(key[1]).alias("type"), F.lit(key[2]).alias("to"), "count"
        )
        for key, signed in sorted(changes.edges.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def apply_to_patterns(stored: DataFrame, changes: Changes) -> DataFrame:
    """The pattern counts (from, type, to, count) after the changes."""
    if not changes.edges:
        return stored
    whole = stored.select("from", "type", "to", F.col("count").cast("bigint").alias("count")).unionByName(pattern_changes(changes))
    return whole.groupBy("from", "type", "to").agg(F.sum("count").alias("count")).where("count > 0")


def apply_to_label_counts(stored: DataFrame, changes: Changes) -> DataFrame:
    """The node counts (label, count) after the changes."""
    parts = [frame.agg(F.count(F.lit(1)).alias("count")).select(F.lit(label).alias("label"), "count") for label, frame in sorted(changes.nodes.items())]
    whole = reduce(DataFrame.unionByName, [stored.select("label", F.col("count").cast("bigint").alias("count")), *parts])
    return whole.groupBy("label").agg(F.sum("count").alias("count"))
