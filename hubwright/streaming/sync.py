"""Keeping a graph in step with a changing table, by a high-water mark.

Rows are picked up by ``column >= mark``; rows at the mark itself are merged
again, which changes nothing. Rows whose column is NULL are only seen by a full
run, and deletes are not carried over: ``verify_surplus`` finds them.

``sync_stream`` takes the rows as a stream instead: each micro-batch becomes one version of a bucketed store, written
together with its name and mark, so that a batch repeated after a failure changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from hubwright.functions.values import to_text
from hubwright.operators.build import build_graph
from hubwright.operators.graph import ID, PropertyGraph
from hubwright.operators.upsert import insert_missing, upsert_edges, upsert_nodes
from hubwright.plans.model import JoinModel, Model
from hubwright.sources import buckets
from hubwright.sources.state import read_state, write_state
from hubwright.sources.tables import TableSpec


def merge_load(graph: PropertyGraph, spec: TableSpec, model: Model, replace_for_upserted: bool = True) -> PropertyGraph:
    """Merge the rows of a table into a graph.

    With ``replace_for_upserted`` a row whose link changed loses its old edge;
    without, the old edge stays beside the new one.
    """
    fresh = build_graph([(spec, model)])
    nodes = dict(graph.nodes)
    touched = None
    if not isinstance(model, JoinModel):
        loaded = build_graph([(spec, replace(model, relationships=()))]).nodes[model.label]
        nodes[model.label] = upsert_nodes(nodes[model.label], loaded) if model.label in nodes else loaded
        touched = loaded.select(ID) if replace_for_upserted else None
    for label, frame in fresh.nodes.items():
        only_loaded = not isinstance(model, JoinModel) and label == model.label and all(r.to_label != label for r in model.relationships)
        if not only_loaded:
            # hubs and key-only nodes have nothing to update
            nodes[label] = insert_missing(nodes[label], frame) if label in nodes else frame
    edges = dict(graph.edges)
    for key, frame in fresh.edges.items():
        edges[key] = upsert_edges(edges[key], frame, touched) if key in edges else frame
    return PropertyGraph(nodes, edges)


def sync_full(graph: PropertyGraph, spec: TableSpec, model: Model, replace_for_upserted: bool = True) -> PropertyGraph:
    """Merge every row again; a second run changes nothing."""
    return merge_load(graph, spec, model, replace_for_upserted)


def changed_rows(df: DataFrame, column: str, mark) -> DataFrame:
    """Rows at or above the mark; the comparison reaches the Parquet scan."""
    return df.where(F.col(f"`{column}`") >= F.lit(mark).cast(df.schema[column].dataType))


def sync_incremental(
    graph: PropertyGraph, spec: TableSpec, model: Model, column: str, mark, replace_for_upserted: bool = True
) -> PropertyGraph:
    """Merge only rows at or above the mark."""
    delta = replace(spec, df=changed_rows(spec.df, column, mark))
    return merge_load(graph, delta, model, replace_for_upserted)


def sync_delta(df: DataFrame, column: str, mark) -> DataFrame:
    """What an incremental run would take, and what it cannot see."""
    at = F.lit(mark).cast(df.schema[column].dataType)
    value = F.col(f"`{column}`")
    return df.agg(
        F.count_if(value >= at).alias("changed"),
        F.count_if(value == at).alias("at_mark"),
        F.count_if(value.isNull()).alias("without_mark"),
    )


def high_water(df: DataFrame, column: str) -> DataFrame:
    """The new mark as text, NULL if there is none."""
    top = df.agg(F.max(F.col(f"`{column}`")).alias("top"))
    return top.select(to_text(F.col("top"), df.schema[column].dataType).alias("high_water"))


@dataclass(frozen=True)
class Synced:
    graph: PropertyGraph
    mode: str
    high_water: str | None


def plan_sync(graph: PropertyGraph, spec: TableSpec, model: Model, state_path: str, column: str | None = None) -> Synced:
    """Choose full or incremental by the stored mark and merge accordingly.

    The new mark is read from the same frame that is merged, so no row can slip
    in between. Link tables, another column than last time and a missing mark
    lead to a full run. Save the graph, then call ``commit_mark``.
    """
    spark = spec.df.sparkSession
    mark = None
    if column and not isinstance(model, JoinModel):
        row = read_state(spark, state_path).where(
            (F.col("source_table") == spec.name) & (F.col("column") == column)
        ).first()
        mark = row["high_water"] if row else None
    top = high_water(spec.df, column).first()["high_water"] if column else None
    if mark is None:
        return Synced(sync_full(graph, spec, model), "full", top)
    return Synced(sync_incremental(graph, spec, model, column, mark), f"incremental(>= {mark})", top)


def commit_mark(spec: TableSpec, state_path: str, column: str, synced: Synced) -> None:
    """Store the mark once the graph it belongs to is saved."""
    write_state(spec.df.sparkSession, state_path, spec.name, column, synced.high_water)


def latest_rows(df: DataFrame, key: tuple[str, ...], column: str) -> DataFrame:
    """Of each key the row with the greatest ``column``, a NULL being the least; equal ones go by the whole row."""
    order = F.struct(F.col(f"`{column}`").isNotNull(), F.col(f"`{column}`"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    newest = df.groupBy(*[F.col(f"`{c}`") for c in key]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("_row"))
    return newest.select("_row.*")


def merge_batch(path: str, spec: TableSpec, model: Model, column: str | None = None, name: str = "sync", replace_for_upserted: bool = True):
    """What a stream calls for each micro-batch: ``foreachBatch(merge_batch(...))``.

    Writes the batch as one version of the store under ``path``. Its name is kept in the same commit, and so is the
    mark, the greatest ``column`` of this and all earlier batches.
    """

    def merge(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        if df.isEmpty():
            return
        mark = None
        if column:
            top = df.agg(F.max(F.col(f"`{column}`")).alias("top"))
            known = F.lit(buckets.stored_mark(spark, path)).cast(df.schema[column].dataType)
            mark = high_water(top.select(F.greatest("top", known).alias(column)), column).first()["high_water"]
            if spec.primary_key:
                df = latest_rows(df, spec.primary_key, column)
        buckets.upsert(spark, path, replace(spec, df=df), model, replace_for_upserted, batch=f"{name}-{number}", mark=mark)

    return merge


def sync_stream(
    stream: DataFrame, path: str, spec: TableSpec, model: Model, checkpoint: str, column: str | None = None,
    name: str = "sync", replace_for_upserted: bool = True,
) -> StreamingQuery:
    """Merge all rows that have arrived since the last run into the store under ``path``, then stop.

    ``checkpoint`` remembers what was read, ``name`` must be as lasting as it is: with a new checkpoint give a new name.
    Of rows with one key in a batch the newest by ``column`` is taken; across batches the later arrival wins.
    """
    merge = merge_batch(path, spec, model, column, name, replace_for_upserted)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
