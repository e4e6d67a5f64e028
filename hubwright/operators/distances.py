"""Distances of many pairs of nodes at once, through trees first and then with bounds from landmarks.

Nodes with one neighbour are taken off round by round. What goes so are trees that hang on the rest, or whole trees; in them
there is one way, so pairs walk up, the end that went earlier first, until both ends meet or have left the trees. Only
the nodes they leave at, each pair of them once, are searched for in the rest, which has nothing but cycles and what links them.

A few nodes of highest degree are landmarks. One search from all of them together gives every node its hops to each, kept
as one short array per node. The triangle inequality turns two such arrays into a lower and an upper bound of
the distance between their nodes; where the bounds meet, the pair is answered without a search. The other pairs are searched together,
one step per round from the side that has fewer nodes open; a node is dropped if even its lower bound to the pair's other end
would not beat the pair's upper bound.

Paths go along edges of all types, in both directions, as in ``paths.shortest_path``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hubwright.operators.graph import ID, PropertyGraph
from hubwright.session import broadcast_if_small, stage_table

LANDMARKS = 8


def both_ways(graph: PropertyGraph) -> DataFrame:
    """``at``, ``next``: every edge from both its ends, once; nodes as (label, id)."""
    edges = graph.all_edges()
    near = F.struct(F.col("from_label").alias("label"), F.col("src_id").alias("id"))
    far = F.struct(F.col("to_label").alias("label"), F.col("dst_id").alias("id"))
    return edges.select(near.alias("at"), far.alias("next")).unionByName(edges.select(far.alias("at"), near.alias("next"))).distinct()


def landmark_hops(steps: DataFrame, landmarks: int = LANDMARKS) -> DataFrame:
    """``at`` and ``hops``, a map from landmark to hops; nodes that no landmark reaches are left out.

    One round per hop, from the nodes that the round before has reached anew. ``steps``: written before.
    """
    degree = steps.groupBy("at").count()
    first = degree.orderBy(F.desc("count"), "at").limit(landmarks).collect()
    rows = [((r["at"]["label"], r["at"]["id"]), i, 0) for i, r in enumerate(first)]
    new = known = stage_table(steps.sparkSession.createDataFrame(rows, "at struct<label:string,id:string>, mark int, hops int"))
    hop = 0
    while not new.isEmpty():
        hop += 1
        # a node reached by several ways at once is one row per landmark before the shuffle
        met = new.join(steps, "at").select(F.col("next").alias("at"), "mark").distinct()
        new = stage_table(met.join(known.select("at", "mark"), ["at", "mark"], "left_anti").withColumn("hops", F.lit(hop)))
        known = known.unionByName(new)
    return known.groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("mark", "hops"))).alias("hops"))


def _bound(a: str, b: str, landmarks: int, lower: bool) -> Column:
    """Bound of the distance between nodes with the maps ``a`` and ``b``; NULL without a landmark that reaches both."""
    each = []
    for i in range(landmarks):
        x, y = F.try_element_at(a, F.lit(i)), F.try_element_at(b, F.lit(i))
        each.append(F.abs(x - y) if lower else x + y)
    return reduce(lambda p, q: (F.greatest if lower else F.least)(p, q), each) if len(each) > 1 else each[0]


def fringe(steps: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Per round the nodes that went, ``at``, with the neighbour they hung on, ``up``; and the steps between nodes that stay.

    Of two nodes that have only each other the smaller stays. ``steps``: both ways, each once, written before.
    """
    gone, rest = [], steps.where("at != next")
    while True:
        single = stage_table(rest.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("next").alias("up")).where("n = 1").drop("n"))
        last = single.select(F.col("at").alias("up")).join(single, "up").where("at < up").select("at")
        leaves = stage_table(single.join(last, "at", "left_anti"))
        if leaves.isEmpty():
            return gone, rest
        gone.append(leaves)
        ends = leaves.select("at")
        rest = stage_table(rest.join(ends, "at", "left_anti").join(ends.withColumnRenamed("at", "next"), "next", "left_anti").select("at", "next"))


def _climbed(pairs: DataFrame, gone: list[DataFrame]) -> tuple[list[DataFrame], DataFrame]:
    """``source``, ``target``, the nodes ``a`` and ``b`` that the ends have come to and ``walked``: pairs that met by round, and all others."""
    met, rest = [], pairs.select("source", "target", F.col("source").alias("a"), F.col("target").alias("b"), F.lit(0).alias("walked"))
    for leaves in [None, *gone]:
        if leaves is not None:
            up = broadcast_if_small(leaves)
            for end in ("a", "b"):
                rest = rest.join(up.select(F.col("at").alias(end), "up"), end, "left")
                rest = rest.withColumn("walked", F.col("walked") + F.col("up").isNotNull().cast("int")).withColumn(end, F.coalesce("up", end)).drop("up")
        rest = stage_table(rest)
        met.append(rest.where("a = b"))
        rest = rest.where("a != b")
    return met, rest


def distances(graph: PropertyGraph, pairs: DataFrame, landmarks: int = LANDMARKS) -> DataFrame:
    """``pairs`` (source, target: structs of label and id) with ``hops``, NULL where there is no path. Pairs are taken once each."""
    gone, core = fringe(stage_table(both_ways(graph)))
    met, rest = _climbed(pairs.select("source", "target").distinct(), gone)
    answers = [m.select("source", "target", F.col("walked").alias("hops")) for m in met]
    if core.isEmpty():
        between = rest.withColumn("hops", F.lit(None).cast("int"))
    else:
        asked = rest.select(F.col("a").alias("source"), F.col("b").alias("target")).distinct()
        known = _between(core, asked, landmarks).select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("hops").alias("rest"))
        between = rest.join(known, ["a", "b"]).withColumn("hops", F.col("walked") + F.col("rest"))
    return reduce(DataFrame.unionByName, answers, between.select("source", "target", "hops"))


def _between(steps: DataFrame, asked: DataFrame, landmarks: int) -> DataFrame:
    """Distinct pairs with ``hops``, by landmarks and a search of what they leave open. ``steps``: written before."""
    marks = stage_table(landmark_hops(steps, landmarks))
    for end in ("source", "target"):
        asked = asked.join(marks.select(F.col("at").alias(end), F.col("hops").alias(f"{end}_hops")), end, "left")
    apart = F.col("source_hops").isNull() != F.col("target_hops").isNull()
    bounded = stage_table(
        asked.select(
            F.monotonically_increasing_id().alias("pair"), "source", "target",
            F.when(F.col("source") == F.col("target"), 0).otherwise(_bound("source_hops", "target_hops", landmarks, True)).alias("lower"),
            F.when(F.col("source") == F.col("target"), 0).otherwise(_bound("source_hops", "target_hops", landmarks, False)).alias("upper"),
            apart.alias("apart"), "source_hops", "target_hops",
        )
    )
    # one of a component with landmarks, the other not; or two components with landmarks of their own
    both = F.col("source_hops").isNotNull() & F.col("target_hops").isNotNull()
    no_path = F.col("apart") | (both & F.col("upper").isNull())
    settled = F.col("lower") == F.col("upper")
    open_ = bounded.where(~no_path & ~F.coalesce(settled, F.lit(False)))
    found = _searched(steps, marks, open_, landmarks)
    answers = bounded.select("pair", "source", "target", F.when(F.coalesce(settled, F.lit(False)), F.col("upper")).alias("known"), "upper")
    # a search that found nothing shorter leaves the upper bound
    joined = answers.join(found, "pair", "left")
    return joined.select("source", "target", F.coalesce("known", F.least("found", "upper")).alias("hops"))


def _searched(steps: DataFrame, marks: DataFrame, open_: DataFrame, landmarks: int) -> DataFrame:
    """``pair`` and ``found``, the shortest way met by searching all pairs together from both ends."""
    other = {"source": "target", "target": "source"}
    level = {s: stage_table(open_.select("pair", F.col(s).alias("at"), F.lit(0).alias("hop"), F.col(f"{other[s]}_hops").alias("there"), "upper")) for s in other}
    seen = {s: level[s].select("pair", "at", "hop") for s in other}
    depth, size, met = {"source": 0, "target": 0}, {s: level[s].count() for s in other}, []
    while size["source"] and size["target"]:
        side = min(size, key=size.get)
        depth[side] += 1
        total = depth["source"] + depth["target"]
        moved = level[side].join(steps, "at").select("pair", F.col("next").alias("at"), "there", "upper").dropDuplicates(["pair", "at"])
        fresh = moved.join(seen[side].select("pair", "at"), ["pair", "at"], "left_anti")
        lower = fresh.join(marks.select("at", "hops"), "at", "left").withColumn("left", F.coalesce(_bound("hops", "there", landmarks, True), F.lit(0)))
        # what cannot beat the upper bound even at best, and what two sides that have come so far would have met
        useful = F.col("upper").isNull() | (F.col("left") + depth[side] < F.col("upper")) & (F.lit(total) < F.col("upper"))
        level[side] = stage_table(lower.where(useful).select("pair", "at", F.lit(depth[side]).alias("hop"), "there", "upper"))
        seen[side] = seen[side].unionByName(level[side].select("pair", "at", "hop"))
        there = seen[other[side]].select("pair", "at", F.col("hop").alias("other"))
        hit = stage_table(level[side].join(there, ["pair", "at"]).groupBy("pair").agg(F.min(F.col("hop") + F.col("other")).alias("found")))
        met.append(hit)
        # the first meeting of two searches that go level by level is a shortest one
        done = hit.select("pair")
        for s in other:
            level[s] = stage_table(level[s].join(done, "pair", "left_anti"))
            size[s] = level[s].count()
    if not met:
        return open_.select("pair", F.lit(None).cast("int").alias("found")).limit(0)
    return reduce(DataFrame.unionByName, met).groupBy("pair").agg(F.min("found").alias("found"))


def node(label: str, id_: str | Column = ID) -> Column:
    """A node as ``distances`` takes it."""
    return F.struct(F.lit(label).alias("label"), (F.col(id_) if isinstance(id_, str) else id_).alias("id"))
