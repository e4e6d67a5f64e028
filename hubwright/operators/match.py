"""Pattern questions over a graph, as DataFrame operators.

Counts are taken on edge tables before anything is joined, so a hub with a
third of all edges reaches a join as one row per task. Node identities are
unique, so in every join at most the edge side is skewed, and adaptive
execution splits that side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hubwright.operators.graph import DST, EDGE_ENDS, ID, SRC, EdgeKey, PropertyGraph, property_names

DIRECTIONS = ("out", "in", "both")


def match(graph: PropertyGraph, label: str) -> DataFrame:
    """All nodes of a label."""
    return graph.node(label)


def where_dimension(graph: PropertyGraph, label: str, rel_type: str, values: Sequence, target: str | None = None) -> DataFrame:
    """Nodes of a label linked to a hub with one of the given values."""
    ids = [f"value={str(v).lower() if isinstance(v, bool) else v}" for v in values]
    linked = graph.edge(rel_type, label, target).where(F.col(DST).isin(ids)).select(F.col(SRC).alias(ID))
    return graph.node(label).join(linked, ID, "left_semi")


def oriented(edges: DataFrame, direction: str, origin: str = "_from", target: str = "_to") -> DataFrame:
    """Edges read along, against, or both ways; a self-loop is read once."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {', '.join(DIRECTIONS)}, not {direction}")
    rest = [F.col(f"`{c}`") for c in edges.columns if c not in EDGE_ENDS]
    along = edges.select(F.col(SRC).alias(origin), F.col(DST).alias(target), *rest)
    if direction == "out":
        return along
    against = edges.select(F.col(DST).alias(origin), F.col(SRC).alias(target), *rest)
    if direction == "in":
        return against
    return along.unionByName(against.where(F.col(origin) != F.col(target)))


def expand(
    graph: PropertyGraph,
    frame: DataFrame,
    rel_type: str,
    direction: str = "out",
    on: str = ID,
    to: str = "other_id",
    from_label: str | None = None,
    to_label: str | None = None,
) -> DataFrame:
    """One row per edge between a row's node (``on``) and a neighbour (``to``); edge properties follow.

    The labels are those of the edge itself, whichever way it is read. They may be left out only
    where one pair of labels has the type.
    """
    steps = oriented(graph.edge(rel_type, from_label, to_label), direction, on, to)
    return frame.join(steps, on)


def attach(graph: PropertyGraph, frame: DataFrame, label: str, on: str, columns: Sequence[str], prefix: str = "") -> DataFrame:
    """Look up properties of the nodes a column points at."""
    wanted = graph.node(label).select(F.col(ID).alias(on), *[F.col(f"`{c}`").alias(prefix + c) for c in columns])
    return frame.join(wanted, on)


def aggregate(frame: DataFrame, by: Sequence[str], **measures: Column) -> DataFrame:
    """Group by every returned column that is not a measure."""
    return frame.groupBy(*by).agg(*[c.alias(name) for name, c in measures.items()])


def count_per_target(graph: PropertyGraph, label: str, rel_type: str, target: str, prop: str = "value") -> DataFrame:
    """Rows per hub or referenced node, largest first."""
    counts = graph.edge(rel_type, label, target).groupBy(F.col(DST).alias(ID)).agg(F.count(F.lit(1)).alias("row_count"))
    named = attach(graph, counts, target, ID, [prop])
    return named.select(prop, "row_count").orderBy(F.desc("row_count"), prop)


def count_distinct_neighbors(
    graph: PropertyGraph, rel_type: str, by: str = DST, of: str = SRC, from_label: str | None = None, to_label: str | None = None
) -> DataFrame:
    """Distinct nodes at one end of a type per node at the other."""
    return graph.edge(rel_type, from_label, to_label).groupBy(by).agg(F.count_distinct(of).alias("neighbors"))


def where_count(counts: DataFrame, column: str, above: int) -> DataFrame:
    """Filter after aggregation."""
    return counts.where(F.col(column) > above)


def top_k(frame: DataFrame, k: int, by: str, ties: Sequence[str]) -> DataFrame:
    """The k largest; every task keeps k rows, and ties fall the same way on every run."""
    return frame.orderBy(F.desc(by), *ties).limit(k)


def busiest(
    graph: PropertyGraph, rel_type: str, k: int = 10, from_label: str | None = None, to_label: str | None = None
) -> DataFrame:
    """Targets with the most incoming edges of a type."""
    degree = graph.edge(rel_type, from_label, to_label).groupBy(F.col(DST).alias("target_id")).agg(F.count(F.lit(1)).alias("degree"))
    return top_k(degree, k, "degree", ["target_id"])


def sum_edge_property(
    graph: PropertyGraph,
    rel_type: str,
    prop: str,
    k: int = 10,
    exact: str | None = None,
    from_label: str | None = None,
    to_label: str | None = None,
) -> DataFrame:
    """Sources with the largest total of a numeric edge property.

    Summed in the property's own type. A sum of floating-point numbers depends in its last digits on the order of
    tasks; with ``exact``, a decimal type whose scale holds the values, it does not.
    """
    value = F.col(f"`{prop}`")
    totals = (
        graph.edge(rel_type, from_label, to_label)
        .groupBy(F.col(SRC).alias("source_id"))
        .agg(F.sum(value.cast(exact) if exact else value).alias("total"))
    )
    return top_k(totals, k, "total", ["source_id"])


def shared_neighbor_counts(
    graph: PropertyGraph, rel_type: str, k: int | None = 10, from_label: str | None = None, to_label: str | None = None
) -> DataFrame:
    """How many pairs of rows share each hub: d rows make d*(d-1)/2 pairs, none of them is built."""
    degree = graph.edge(rel_type, from_label, to_label).groupBy(F.col(DST).alias("hub_id")).agg(F.count(F.lit(1)).alias("rows"))
    pairs = degree.select("hub_id", F.expr("rows * (rows - 1) div 2").alias("pairs")).where("pairs > 0")
    return pairs if k is None else top_k(pairs, k, "pairs", ["hub_id"])


#: Values that an array holds at most: hubs, not entities.
MOST_COLLECTED = 10_000


def _two_steps(
    graph: PropertyGraph, first: str, second: str, label: str | None, first_target: str | None, second_target: str | None
) -> tuple[EdgeKey, EdgeKey]:
    pairs = [
        (one, two)
        for one in graph.edge_keys(first, label, first_target)
        for two in graph.edge_keys(second, label, second_target)
        if one[0] == two[0]
    ]
    if len(pairs) != 1:
        raise ValueError(f"{len(pairs)} patterns have {first} and {second} from one label; name the labels")
    return pairs[0]


def two_hop_pairs(
    graph: PropertyGraph,
    first: str,
    second: str,
    label: str | None = None,
    first_target: str | None = None,
    second_target: str | None = None,
) -> DataFrame:
    """``(a)<-[first]-(x)-[second]->(b)``: each a with each b reached from it, as rows ``start_id``, ``end_id``; ``label`` is that of x."""
    one, two = _two_steps(graph, first, second, label, first_target, second_target)
    steps = graph.edges[one].select(SRC, F.col(DST).alias("start_id")).join(graph.edges[two].select(SRC, F.col(DST).alias("end_id")), SRC)
    return steps.select("start_id", "end_id").distinct()


def collect_two_hops(
    graph: PropertyGraph,
    first: str,
    second: str,
    value: str = "value",
    label: str | None = None,
    first_target: str | None = None,
    second_target: str | None = None,
    most: int = MOST_COLLECTED,
) -> DataFrame:
    """``(a)<-[first]-(x)-[second]->(b)``: the distinct values of b reached from each a, sorted.

    One array per a holds the values, so b must be a hub: with more than ``most`` nodes it raises, and
    ``two_hop_pairs`` gives the same as rows.
    """
    _, two = _two_steps(graph, first, second, label, first_target, second_target)
    hubs = graph.node(two[2])
    if hubs.limit(most + 1).count() > most:
        raise ValueError(f"{two[2]} has more than {most} nodes; take two_hop_pairs")
    reached = two_hop_pairs(graph, first, second, label, first_target, second_target)
    names = hubs.select(F.col(ID).alias("end_id"), value)
    return reached.join(names, "end_id").groupBy("start_id").agg(F.array_sort(F.collect_set(value)).alias("reached"))


def paths_from(graph: PropertyGraph, label: str, limit: int = 300, keys: Sequence[EdgeKey] | None = None) -> DataFrame:
    """One-step paths of any type out of a label, the first ``limit`` in order of their ends."""
    keys = graph.edge_keys(from_label=label) if keys is None else keys
    return (
        graph.all_edges(keys)
        .select(
            F.array(
                F.struct(F.col("from_label").alias("label"), F.col(SRC).alias("id")),
                F.struct(F.col("to_label").alias("label"), F.col(DST).alias("id")),
            ).alias("nodes"),
            F.array("type").alias("types"),
        )
        .orderBy("nodes", "types")
        .limit(limit)
    )


def lookup(graph: PropertyGraph, label: str, keys: DataFrame) -> DataFrame:
    """Nodes for a list of keys, given as a frame with an ``_id`` column (or its parts exploded)."""
    return graph.node(label).join(keys.select(ID).distinct(), ID, "left_semi")


def has_property(frame: DataFrame, prop: str) -> DataFrame:
    """Nodes that have the property; an absent one is NULL."""
    if prop not in property_names(frame):
        return frame.limit(0)
    return frame.where(F.col(f"`{prop}`").isNotNull())
