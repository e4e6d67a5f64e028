"""Proof that a graph holds what its source table holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from hubwright.functions.values import node_id
from hubwright.operators.build import keyed_rows
from hubwright.operators.graph import DST, EDGE_ENDS, ID, KEY, SRC, PropertyGraph
from hubwright.plans.model import JoinModel, Model
from hubwright.session import broadcast_if_small, cut_lineage

SAMPLE = 100


def source_keys(df: DataFrame, model: Model) -> DataFrame:
    """Node key or pair of ends of every source row, NULL where a part is missing."""

    def of(names, columns):
        return node_id([(n, F.col(f"`{c}`"), df.schema[c].dataType) for n, c in zip(names, columns)])

    if isinstance(model, JoinModel):
        return df.select(of(model.from_key, model.from_via).alias(SRC), of(model.to_key, model.to_via).alias(DST))
    if model.synthetic:
        return keyed_rows(df, model).select(ID)
    return df.select(of(model.key, model.key).alias(ID))


def graph_keys(graph: PropertyGraph, model: Model) -> DataFrame:
    """Keys the graph has. Nodes of the label with another key property are not this table's."""
    if isinstance(model, JoinModel):
        return graph.edges[model.from_label, model.rel_type, model.to_label].select(*EDGE_ENDS)
    return graph.node(model.label).where(F.col(KEY) == ",".join(model.key)).select(ID)


def _tally(df: DataFrame, graph: PropertyGraph, model: Model) -> DataFrame:
    """How often each key occurs in the source and in the graph: one shuffle for both, reduced before it."""
    source = source_keys(df, model)
    keys = source.columns
    marked = source.withColumn("in_source", F.lit(1)).withColumn("in_graph", F.lit(0)).unionByName(
        graph_keys(graph, model).withColumn("in_source", F.lit(0)).withColumn("in_graph", F.lit(1))
    )
    return marked.groupBy(*keys).agg(F.sum("in_source").alias("in_source"), F.sum("in_graph").alias("in_graph"))


def _complete(tally: DataFrame):
    present = None
    for c in tally.columns:
        if c not in ("in_source", "in_graph"):
            present = F.col(c).isNotNull() if present is None else present & F.col(c).isNotNull()
    return present


def verify(df: DataFrame, graph: PropertyGraph, model: Model) -> DataFrame:
    """One row: counts on both sides, what is missing, and ``ok``.

    Distinct keys are compared, since equal keys make one node; repeated rows
    and rows that cannot make a node or edge are reported apart.
    """
    tally = _tally(df, graph, model)
    full = _complete(tally)

    def total(column):
        return F.coalesce(F.sum(column), F.lit(0))

    counted = tally.agg(
        total(F.when(full, F.col("in_source"))).alias("source_rows"),
        F.count_if(full & (F.col("in_source") > 0)).alias("source_keys"),
        total(F.when(full, F.col("in_graph"))).alias("graph_count"),
        total(F.when(~full, F.col("in_source"))).alias("keyless_rows"),
        F.count_if(full & (F.col("in_source") > 0) & (F.col("in_graph") == 0)).alias("missing"),
    )
    return counted.select(
        "*", ((F.col("source_keys") == F.col("graph_count")) & (F.col("missing") == 0)).alias("ok")
    )


def verify_counts(df: DataFrame, graph: PropertyGraph, model: Model) -> DataFrame:
    """Source rows, distinct keys among them, what the graph has, and whether the two agree."""
    return verify(df, graph, model).select(
        "source_rows",
        "source_keys",
        "graph_count",
        (F.col("source_rows") - F.col("source_keys")).alias("repeated_rows"),
        (F.col("source_keys") == F.col("graph_count")).alias("match"),
    )


def verify_full(df: DataFrame, graph: PropertyGraph, model: Model) -> DataFrame:
    """Every key of the source that the graph lacks."""
    tally = _tally(df, graph, model)
    return tally.where(_complete(tally) & (F.col("in_source") > 0) & (F.col("in_graph") == 0)).drop("in_source", "in_graph")


def verify_surplus(df: DataFrame, graph: PropertyGraph, model: Model) -> DataFrame:
    """Every key of the graph that the source no longer has: deletes are not carried over."""
    tally = _tally(df, graph, model)
    return tally.where((F.col("in_source") == 0)).drop("in_source", "in_graph")


def verify_sample(df: DataFrame, graph: PropertyGraph, model: Model, n: int = SAMPLE, seed: int = 0) -> DataFrame:
    """``checked`` random rows of the source and how many are ``missing`` in the graph; none for hashed keys."""
    keys = source_keys(df, model).dropna()
    if not isinstance(model, JoinModel) and model.synthetic:
        keys = keys.limit(0)
    # written once, so that both uses see the same n rows
    picked = cut_lineage(keys.orderBy(F.rand(seed), *keys.columns).limit(n))
    found = graph_keys(graph, model).join(broadcast_if_small(picked), picked.columns, "left_semi").distinct()
    marked = picked.join(found.withColumn("held", F.lit(True)), picked.columns, "left")
    return marked.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("held").isNull()).alias("missing"))


@dataclass(frozen=True)
class Verdict:
    ok: bool
    source_keys: int
    graph_count: int
    missing: int


def verdict(df: DataFrame, graph: PropertyGraph, model: Model) -> Verdict:
    row = verify(df, graph, model).first()
    return Verdict(row["ok"], row["source_keys"], row["graph_count"], row["missing"])
