"""Variable-length and shortest paths by joins on the edge tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from hubwright.operators.graph import ID, PropertyGraph
from hubwright.operators.match import oriented
from hubwright.session import broadcast_if_small, cut_lineage, stage_table


def expand_path(
    graph: PropertyGraph,
    frame: DataFrame,
    rel_type: str,
    shortest: int,
    longest: int | None,
    direction: str = "out",
    from_label: str | None = None,
    to_label: str | None = None,
) -> DataFrame:
    """``-[:R*shortest..longest]->`` from the nodes of a frame: ``start_id``, ``end_id``, ``hops``, ``nodes``.

    An edge occurs once per path, a node may recur. Stops when no path grows; with ``longest`` None nothing else
    ends a walk, which suits hierarchies. All paths are returned, so where walks branch and meet again their number is bounded by
    ``longest`` alone; ``reach.reachable`` gives ends and hops without listing them.

    Walks run together, up a hierarchy into a few nodes. A hop reads the steps out of the nodes reached; where those are
    few, they are sent to the paths, which so are neither shuffled nor sorted by the nodes they end at.
    """
    if shortest < 0 or longest is not None and longest < shortest:
        raise ValueError("need 0 <= shortest <= longest")
    edges = graph.edge(rel_type, from_label, to_label)
    steps = oriented(
        edges.withColumn("edge", F.struct(*[F.col(c) for c in ("src_id", "dst_id")])), direction, "end_id", "next_id"
    ).select("end_id", "next_id", "edge")
    paths = frame.select(
        F.col(ID).alias("start_id"),
        F.col(ID).alias("end_id"),
        F.array(ID).alias("nodes"),
        F.array().cast("array<struct<src_id:string,dst_id:string>>").alias("walked"),
    )
    found = []
    if shortest == 0:
        found.append(paths.withColumn("hops", F.lit(0)))
    for hop in count(1) if longest is None else range(1, longest + 1):
        ends = paths.select("end_id").distinct()
        onward = broadcast_if_small(cut_lineage(steps.join(ends, "end_id", "left_semi")))
        paths = cut_lineage(
            paths.join(onward, "end_id")
            .where(~F.array_contains("walked", F.col("edge")))
            .select(
                "start_id",
                F.col("next_id").alias("end_id"),
                F.array_append("nodes", F.col("next_id")).alias("nodes"),
                F.array_append("walked", F.col("edge")).alias("walked"),
            )
        )
        if paths.isEmpty():
            break
        if hop >= shortest:
            found.append(paths.withColumn("hops", F.lit(hop)))
    if not found:
        found.append(paths.withColumn("hops", F.lit(shortest)).limit(0))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result.select("start_id", "end_id", "hops", "nodes")


FOUND, NONE, LONGER = "found", "none", "longer"
_PATH = "array<struct<label:string,id:string,via:string>>"


def shortest_path(graph: PropertyGraph, source: tuple[str, str], target: tuple[str, str], longest: int) -> DataFrame:
    """A shortest path of any edge types and directions between two (label, id) nodes: one row with ``status``.

    ``found`` has ``nodes``, ``types`` and ``hops``; ``none`` says that there is no path, ``longer`` that there
    may be one of more than ``longest`` hops. Of several shortest paths the smallest by its nodes is returned.

    The edges are written once, each both ways. Two frontiers, one from each end, are joined with them,
    always the one with fewer steps ahead; a frontier keeps one path per node and drops nodes that its side has reached before.
    Before a frontier is moved, edges from one to the other are looked for: the last hop, often into a hub's fan-out, is
    never walked. Frontiers of few nodes are sent to the edges, which so are not shuffled by their hubs.
    """
    spark = next(iter(graph.nodes.values())).sparkSession
    at = lambda node: F.struct(F.lit(node[0]).alias("label"), F.lit(node[1]).alias("id"))
    first = F.array(F.struct(F.lit(source[0]).alias("label"), F.lit(source[1]).alias("id"), F.lit("").alias("via")))
    # from the source: the nodes so far; from the target: the nodes still to come
    level = {
        "source": spark.range(1).select(at(source).alias("at"), first.cast(_PATH).alias("path")),
        "target": spark.range(1).select(at(target).alias("at"), F.array().cast(_PATH).alias("path")),
    }
    if source == target:
        return _as_path(level["source"])
    steps = stage_table(_both_ways(graph))
    ahead, reached, none = {side: _steps_ahead(level[side], steps) for side in level}, {side: level[side].select("at") for side in level}, NONE
    for hop in range(1, longest + 1):
        met = cut_lineage(_linked(level, steps).agg(F.min("path").alias("path")).where("path is not null"))
        if not met.isEmpty():
            return _as_path(met)
        side = min(ahead, key=ahead.get)
        if hop == longest:  # what the last hop reaches is not needed, only whether it reaches anything
            none = NONE if _beyond(level[side], steps, reached[side]).isEmpty() else LONGER
            break
        level[side] = cut_lineage(next_level(level[side], steps, side).join(reached[side], "at", "left_anti"))
        if level[side].isEmpty():
            break
        ahead[side] = _steps_ahead(level[side], steps)
        reached[side] = reached[side].unionByName(level[side].select("at"))
    else:
        none = LONGER
    return spark.createDataFrame([(none, None, None, None)], _as_path(level["source"]).schema.simpleString()[len("struct<") : -1])


def _both_ways(graph: PropertyGraph) -> DataFrame:
    edges = graph.all_edges()
    near = F.struct(F.col("from_label").alias("label"), F.col("src_id").alias("id"))
    far = F.struct(F.col("to_label").alias("label"), F.col("dst_id").alias("id"))
    along = edges.select(near.alias("at"), far.alias("next"), "type")
    return along.unionByName(edges.select(far.alias("at"), near.alias("next"), "type"))


def _ahead(level: DataFrame, steps: DataFrame) -> DataFrame:
    return steps.join(broadcast_if_small(level.select("at")), "at", "left_semi")


def _steps_ahead(level: DataFrame, steps: DataFrame) -> int:
    return _ahead(level, steps).count()


def _beyond(level: DataFrame, steps: DataFrame, reached: DataFrame) -> DataFrame:
    """Nodes one step further that were not reached before."""
    return _ahead(level, steps).select(F.col("next").alias("at")).join(reached, "at", "left_anti")


def _linked(level: dict[str, DataFrame], steps: DataFrame) -> DataFrame:
    """Paths that one edge between the two frontiers completes."""
    near = broadcast_if_small(level["source"])
    far = broadcast_if_small(level["target"].select(F.col("at").alias("next"), F.col("path").alias("rest")))
    step = F.struct(F.col("next.label").alias("label"), F.col("next.id").alias("id"), F.col("type").alias("via"))
    return steps.join(near, "at").join(far, "next").select(F.concat(F.array_append("path", step).cast(_PATH), "rest").alias("path"))


def next_level(level: DataFrame, steps: DataFrame, side: str) -> DataFrame:
    """The nodes one step further from their side, each with its smallest path."""
    node = "next" if side == "source" else "at"
    step = F.struct(F.col(f"{node}.label").alias("label"), F.col(f"{node}.id").alias("id"), F.col("type").alias("via"))
    longer = F.array_append("path", step) if side == "source" else F.concat(F.array(step), "path")
    # steps lie both ways, so those into a node are those out of it read backwards
    moved = broadcast_if_small(level).join(steps, "at").select(F.col("next"), longer.cast(_PATH).alias("path"))
    return moved.groupBy(F.col("next").alias("at")).agg(F.min("path").alias("path"))


def _as_path(paths: DataFrame) -> DataFrame:
    return paths.select(
        F.lit(FOUND).alias("status"),
        F.transform("path", lambda p: F.struct(p["label"].alias("label"), p["id"].alias("id"))).alias("nodes"),
        F.transform(F.slice("path", F.lit(2), F.size("path")), lambda p: p["via"]).alias("types"),
        (F.size("path") - 1).alias("hops"),
    )
