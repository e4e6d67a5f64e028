"""Pairs of targets that share many sources, without the pairs of a hot source.

Targets that cannot be among the answers go first: a pair shares no more sources than its
less connected end has, and the best connected targets give a count that k pairs reach, the bound.

A source with d targets stands for d*(d-1)/2 pairs, so one source with a third
of all edges must not be expanded. Sources are split by degree:

* light sources (at most ``hot`` targets) are joined with themselves, which is
  at most ``hot`` rows per edge;
* hot sources are few (edges / hot). What counts is which of them a target
  has, so targets with the same set of hot sources form one class, and counts
  are worked out between classes by the class's smallest member.

A pair's count is its light count plus what its two classes share. The bound, raised by the classes with the
largest sets, decides which pairs of classes are counted at all:

* for a pair with a light source in common, its light count and the smaller of its two sets of hot sources must
  reach the bound together, and so must the light count and what two sketches of the sets allow;
* for all others the sets alone must reach it. Each set is put in order, sources of few classes first; two sets that share
  ``bound`` sources have one in common even if the last ``bound - 1`` of both are left out. Sets with fewer sources than the bound
  drop out, and the hottest sources are the ones that are left out.

A sketch counts a set's sources by hash cell. The smaller counts of two sketches, summed, are never less than
what the sets share. Only pairs that pass are counted exactly.

Of each pair of classes only the first k pairs can be among the top k, which the k+1 smallest
members of both classes contain. The answer is exact. Where classes are many, the bound is low and their sets are large and alike,
many pairs of classes reach it and are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hubwright.operators.graph import DST, SRC, PropertyGraph
from hubwright.operators.match import top_k
from hubwright.session import stage_table

HOT_SOURCE = 1000
PROBED = 64  # best connected targets whose pairs set the bound; at most so many rows to an edge
CELLS = 64  # counts in a sketch


def _pairs_by_source(edges: DataFrame, node: str) -> DataFrame:
    """Counts of sources shared by two nodes a < b."""
    left = edges.select(SRC, F.col(node).alias("a"))
    right = edges.select(SRC, F.col(node).alias("b"))
    return left.join(right, SRC).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"))


def _reached(counts: DataFrame, k: int) -> int:
    """The count that k rows reach; 1 if there are fewer rows."""
    found, least = counts.orderBy(F.desc("together")).limit(k).agg(F.count(F.lit(1)), F.min("together")).first()
    return least if found == k else 1


def _possible(edges: DataFrame, k: int) -> tuple[DataFrame, int]:
    """A bound that k pairs reach, those of the best connected targets, and the edges of targets with as many sources."""
    degree = stage_table(edges.groupBy(DST).agg(F.count(F.lit(1)).alias("degree")))
    probed = F.broadcast(degree.orderBy(F.desc("degree"), DST).limit(PROBED).select(DST))
    bound = _reached(_pairs_by_source(edges.join(probed, DST, "left_semi"), DST), k)
    if bound <= 1:
        return edges, 1
    return stage_table(edges.join(degree.where(F.col("degree") >= bound).select(DST), DST, "left_semi")), bound


def _classes(heavy: DataFrame) -> DataFrame:
    """Each target with the leader of its class and the class's number and sketch of hot sources."""
    cell = F.pmod(F.xxhash64(SRC), F.lit(CELLS))
    # two independent hashes summed over the set: equal sums mean equal sets of hot sources
    sets = heavy.groupBy(DST).agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(F.xxhash64(SRC).cast("decimal(38,0)")).alias("sum1"),
        F.sum(F.xxhash64(F.lit("second"), F.reverse(SRC)).cast("decimal(38,0)")).alias("sum2"),
        F.array(*[F.count_if(cell == i).cast("int") for i in range(CELLS)]).alias("sketch"),
    )
    signature = ["size", "sum1", "sum2"]
    leaders = sets.groupBy(*signature).agg(F.min(DST).alias("leader"))
    return sets.join(leaders, signature).select(DST, "leader", "size", "sketch")


def most_shared(one: Column, other: Column) -> Column:
    """The most sources that two sets with these sketches share."""
    return F.aggregate(F.zip_with(one, other, lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda total, n: total + n)


def _raised(bound: int, sets: DataFrame, leaders: DataFrame, members: DataFrame, k: int) -> int:
    """The bound, raised by the classes with the largest sets: pairs within a class share all of it, pairs of leaders what is counted."""
    probed = F.broadcast(leaders.orderBy(F.desc("size"), "leader").limit(PROBED).select(F.col("leader").alias(DST)))
    between = _pairs_by_source(sets.join(probed, DST, "left_semi"), DST).select("together")
    repeated = members.groupBy("leader", "size").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    # m members are at least m - 1 pairs
    within = repeated.select(F.explode(F.array_repeat("size", F.least(F.col("members") - 1, F.lit(k)).cast("int"))).alias("together"))
    return max(bound, _reached(between.unionByName(within), k))


def set_pairs(sets: DataFrame, leaders: DataFrame, bound: int) -> DataFrame:
    """Pairs of leaders la < lb that may share ``bound`` hot sources; all that do are among them."""
    uses = sets.groupBy(SRC).agg(F.count(F.lit(1)).alias("uses"))
    large = leaders.where(F.col("size") >= bound).select(F.col("leader").alias(DST), "size", "sketch")
    place = F.row_number().over(Window.partitionBy(DST).orderBy("uses", SRC))
    kept = sets.join(uses, SRC).join(large, DST).withColumn("place", place).where(F.col("place") <= F.col("size") - bound + 1)
    left = kept.select(SRC, F.col(DST).alias("la"), F.col("sketch").alias("_a"))
    right = kept.select(SRC, F.col(DST).alias("lb"), F.col("sketch").alias("_b"))
    met = left.join(right, SRC).where((F.col("la") < F.col("lb")) & (most_shared(F.col("_a"), F.col("_b")) >= bound))
    return met.select("la", "lb").distinct()


def _counted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Hot sources that pairs of leaders share: la, lb, hot_count."""
    first = pairs.join(sets.select(F.col(DST).alias("la"), SRC), "la")
    both = first.join(sets.select(F.col(DST).alias("lb"), SRC), ["lb", SRC])
    return both.groupBy("la", "lb").agg(F.count(F.lit(1)).alias("hot_count"))


def co_occurrence(
    graph: PropertyGraph, rel_type: str, k: int = 10, hot: int = HOT_SOURCE, from_label: str | None = None, to_label: str | None = None
) -> DataFrame:
    """The k pairs of targets that share the most sources: ``a``, ``b``, ``together``."""
    # written once, as each of the steps below would make them anew; a graph holds one edge per pair of ends
    edges, bound = _possible(stage_table(graph.edge(rel_type, from_label, to_label).select(SRC, DST)), k)
    degree = edges.groupBy(SRC).agg(F.count(F.lit(1)).alias("degree"))
    hot_sources = stage_table(degree.where(F.col("degree") > hot).select(SRC))
    if hot_sources.isEmpty():
        return top_k(_pairs_by_source(edges, DST), k, "together", ["a", "b"])

    # by number: few edges make many pairs, and adaptive execution would put them into one task
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = edges.join(hot_sources, SRC, "left_anti").repartition(tasks, SRC)
    heavy = edges.join(hot_sources, SRC, "left_semi")
    members = stage_table(_classes(heavy))
    leaders = members.where(F.col(DST) == F.col("leader")).drop(DST)
    sets = stage_table(heavy.join(leaders.select(F.col("leader").alias(DST)), DST, "left_semi"))
    bound = _raised(bound, sets, leaders, members, k)

    near = _pairs_by_source(light, DST)
    for end in ("a", "b"):
        known = [F.col(c).alias(f"{end}_{c}") for c in ("leader", "size")]
        near = near.join(members.select(F.col(DST).alias(end), *known), end, "left")
    # sizes leave few pairs for the sketches; null where an end has no hot source
    smaller = F.when(F.col("a_size").isNotNull() & F.col("b_size").isNotNull(), F.least("a_size", "b_size"))
    near = near.where(F.col("together") + F.coalesce(smaller, F.lit(0)) >= bound)
    same = F.col("a_leader") == F.col("b_leader")
    near = near.select(
        "a", "b", "together", F.when(same, F.col("a_size")).alias("within"), F.least("a_leader", "b_leader").alias("la"),
        F.greatest("a_leader", "b_leader").alias("lb"), (smaller.isNotNull() & ~same).alias("between"),
    )
    for end in ("la", "lb"):
        near = near.join(leaders.select(F.col("leader").alias(end), F.col("sketch").alias(f"{end}_sketch")), end, "left")
    most = F.when(F.col("between"), most_shared(F.col("la_sketch"), F.col("lb_sketch")))
    near = near.where(F.col("together") + F.coalesce("within", most, F.lit(0)) >= bound)
    near = stage_table(near.select("a", "b", "together", "within", "la", "lb", "between"))

    if bound == 1:  # nothing to leave out
        shared = _pairs_by_source(sets, DST).select(F.col("a").alias("la"), F.col("b").alias("lb"), F.col("together").alias("hot_count"))
    else:
        asked = near.where("between").select("la", "lb").unionByName(set_pairs(sets, leaders, bound)).distinct()
        shared = _counted(asked, sets)
    shared = stage_table(shared)
    with_hot = near.join(shared.withColumn("between", F.lit(True)), ["la", "lb", "between"], "left")
    exact = with_hot.select("a", "b", (F.col("together") + F.coalesce("within", "hot_count", F.lit(0))).alias("together"))

    first = (
        members.withColumn("rank", F.row_number().over(Window.partitionBy("leader").orderBy(DST)))
        .where(F.col("rank") <= k + 1)
        .select("leader", DST)
    )
    left = first.select(F.col("leader").alias("la"), F.col(DST).alias("x"))
    right = first.select(F.col("leader").alias("lb"), F.col(DST).alias("y"))
    own = leaders.select(F.col("leader").alias("la"), F.col("leader").alias("lb"), F.col("size").alias("hot_count"))
    # at most (k+1)^2 rows for each pair of classes that reaches the bound
    hot_only = (
        shared.unionByName(own)
        .where(F.col("hot_count") >= bound)
        .join(left, "la")
        .join(right, "lb")
        .where((F.col("la") != F.col("lb")) | (F.col("x") < F.col("y")))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("hot_count").alias("together"))
    )
    best = exact.unionByName(hot_only).groupBy("a", "b").agg(F.max("together").alias("together"))
    return top_k(best, k, "together", ["a", "b"])
