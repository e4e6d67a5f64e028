import random
from collections import Counter
from itertools import combinations

import pytest
from helpers import rows
from pyspark.sql import functions as F

from hubwright.operators import cooccurrence, match, paths
from hubwright.operators.build import build_graph
from hubwright.operators.cooccurrence import co_occurrence
from hubwright.operators.graph import PropertyGraph
from hubwright.operators.match import busiest, collect_two_hops, count_distinct_neighbors, expand, shared_neighbor_counts, sum_edge_property
from hubwright.operators.paths import _both_ways, expand_path, next_level, shortest_path
from hubwright.operators.results import as_json, bounded, bounded_rows, nodes_as_result, paths_as_result
from hubwright.plans.model import infer_model
from hubwright.plans.starter import starter_frames
from hubwright.session import cut_lineage, stage_table
from hubwright.sources.tables import TableSpec


def graph_of(shop, *names):
    return build_graph([(shop[n], infer_model(shop[n])) for n in names])


def edges_only(spark, pairs, rel="R", label="N"):
    frame = spark.createDataFrame(sorted(set(pairs)), "src_id string, dst_id string")
    ids = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([(i, "id") for i in ids], "_id string, _key string")
    return PropertyGraph({label: nodes}, {(label, rel, label): frame})


def test_hub_filter(shop):
    graph = graph_of(shop, "orders")
    assert match.where_dimension(graph, "Order", "HAS_STATUS", ["shipped"]).count() == 20
    assert match.where_dimension(graph, "Order", "HAS_STATUS", ["shipped", "pending"]).count() == 40


def test_directions(spark):
    graph = edges_only(spark, [("a", "b"), ("b", "c"), ("c", "c")])
    nodes = graph.node("N").select("_id")
    assert rows(match.expand(graph, nodes, "R", "out")) == [("a", "b"), ("b", "c"), ("c", "c")]
    assert rows(match.expand(graph, nodes, "R", "in")) == [("b", "a"), ("c", "b"), ("c", "c")]
    assert rows(match.expand(graph, nodes, "R", "both")) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "c")]
    with pytest.raises(ValueError):
        match.expand(graph, nodes, "R", "up")


def test_counts_by_hub(shop):
    graph = graph_of(shop, "orders")
    counted = match.count_per_target(graph, "Order", "HAS_STATUS", "Status").collect()
    assert [tuple(r) for r in counted] == [("cancelled", 20), ("pending", 20), ("shipped", 20)]
    busiest = match.busiest(graph, "HAS_CUSTOMER", 5).collect()
    assert [tuple(r) for r in busiest] == [("id=2", 8), ("id=3", 8), ("id=4", 8), ("id=5", 8), ("id=1", 7)]
    pairs = dict(rows(match.shared_neighbor_counts(graph, "HAS_CUSTOMER", None)))
    assert pairs["id=2"] == 28 and pairs["id=1"] == 21


def test_two_hops(shop):
    reached = dict(rows(match.collect_two_hops(graph_of(shop, "orders"), "HAS_CUSTOMER", "HAS_STATUS")))
    assert len(reached) == 8 and all(v == ["cancelled", "pending", "shipped"] for v in reached.values())


def brute_together(pairs, k):
    by_source = {}
    for s, d in set(pairs):
        by_source.setdefault(s, set()).add(d)
    counts = Counter(p for group in by_source.values() for p in combinations(sorted(group), 2))
    return [(a, b, n) for (a, b), n in sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:k]]


@pytest.mark.parametrize("seed, hot", [(1, 1000), (2, 6), (3, 3), (4, 0), (5, 12)])
def test_co_occurrence_with_hot_sources(spark, seed, hot):
    rng = random.Random(seed)
    pairs = [(f"s{rng.randrange(25)}", f"d{rng.randrange(30)}") for _ in range(120)]
    pairs += [("hot", f"d{i}") for i in range(30)]  # one source with a large share of all edges
    pairs += [("warm", f"d{i}") for i in range(0, 30, 2)]
    graph = edges_only(spark, pairs)
    found = co_occurrence(graph, "R", k=10, hot=hot).collect()
    assert [tuple(r) for r in found] == brute_together(pairs, 10)


def test_only_hot_sources(spark):
    pairs = [(s, f"d{i}") for s in ("x", "y") for i in range(8)] + [("z", "d3"), ("z", "d7")]
    found = co_occurrence(edges_only(spark, pairs), "R", k=4, hot=1).collect()
    assert [tuple(r) for r in found] == brute_together(pairs, 4)


def own_sets(targets, sources, each, seed):
    """Targets that each have their own draw of a few hot sources."""
    rng = random.Random(seed)
    return {f"t{i:04}": frozenset(rng.sample(range(sources), each)) for i in range(targets)}


def test_pairs_of_sets_by_bound(spark):
    drawn = own_sets(300, 16, 6, 7)
    heavy = spark.createDataFrame([(f"s{s}", t) for t, own in drawn.items() for s in own], "src_id string, dst_id string")
    members = stage_table(cooccurrence._classes(heavy))
    leaders = members.where("dst_id = leader").drop("dst_id")
    assert leaders.count() == len(set(drawn.values()))
    sets = stage_table(heavy.join(leaders.selectExpr("leader AS dst_id"), "dst_id", "left_semi"))
    names = [r.leader for r in leaders.collect()]
    shared = {(a, b): len(drawn[a] & drawn[b]) for a, b in combinations(sorted(names), 2)}
    kept = {}
    for bound in (1, 3, 5, 6):
        found = {tuple(r) for r in cooccurrence.set_pairs(sets, leaders, bound).collect()}
        assert found >= {p for p, n in shared.items() if n >= bound}
        kept[bound] = len(found)
    # of some 44,000 pairs with a common source few are left to count
    assert kept[1] > 0.9 * len(shared) and kept[5] < heavy.count() and kept[6] < 200


@pytest.mark.parametrize("k, own_light, planted", [(5, 3, 6), (12, 0, 0), (3, 12, 1), (40, 1, 20)])
def test_targets_with_their_own_hot_sources(spark, k, own_light, planted):
    pairs = [(f"s{s}", t) for t, own in own_sets(150, 12, 5, k).items() for s in own]
    pairs += [(f"x{t}{i}", t) for t in sorted({t for _, t in pairs}) for i in range(own_light)]  # sources of one target alone
    pairs += [(f"p{j}-{i}", t) for j in range(planted) for i in range(4) for t in (f"t{2 * j:04}", f"t{2 * j + 1:04}")]
    found = co_occurrence(edges_only(spark, pairs), "R", k=k, hot=20).collect()
    assert [tuple(r) for r in found] == brute_together(pairs, k)


def test_fewer_pairs_than_asked_for_and_none(spark):
    pairs = [("h", f"d{i}") for i in range(4)] + [("g", "d0"), ("g", "d1")]
    found = co_occurrence(edges_only(spark, pairs), "R", k=50, hot=1).collect()
    assert [tuple(r) for r in found] == brute_together(pairs, 50)
    assert co_occurrence(edges_only(spark, [("h", "d0"), ("g", "d1")]), "R", k=3, hot=0).collect() == []


def test_hierarchy(shop):
    graph = graph_of(shop, "employees")
    up = expand_path(graph, graph.node("Employee").where("name = 'Dev A'"), "HAS_MANAGER", 1, 6)
    assert rows(up.select("end_id", "hops")) == [("id=1", 3), ("id=2", 2), ("id=4", 1)]
    boss = expand_path(graph, graph.node("Employee").where("id = 1"), "HAS_MANAGER", 2, 3, direction="in")
    assert boss.count() == 6
    zero = expand_path(graph, graph.node("Employee").where("name = 'Loner'"), "HAS_MANAGER", 0, 2)
    assert rows(zero.select("end_id", "hops")) == [("id=10", 0)]


def test_cycles_end(spark):
    graph = edges_only(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    walked = expand_path(graph, graph.node("N").where("_id = 'a'"), "R", 1, 10)
    assert rows(walked.select("end_id", "hops")) == [("a", 3), ("b", 1), ("c", 2)]


def test_shortest_path(shop):
    graph = graph_of(shop, "employees")
    found = shortest_path(graph, ("Employee", "id=5"), ("Employee", "id=9"), 6).first()
    assert [n["id"] for n in found["nodes"]] == ["id=5", "id=4", "id=2", "id=1", "id=3", "id=7", "id=9"]
    assert found["hops"] == 6
    assert shortest_path(graph, ("Employee", "id=5"), ("Employee", "id=10"), 9).first()["status"] == "none"
    assert shortest_path(graph, ("Employee", "id=5"), ("Employee", "id=9"), longest=5).first()["status"] == "longer"
    assert shortest_path(graph, ("Employee", "id=5"), ("Employee", "id=5"), 6).first()["hops"] == 0
    assert shortest_path(graph, ("Employee", "id=5"), ("Employee", "id=6"), 6).first()["hops"] == 2


def test_shortest_path_takes_the_smallest(shop):
    graph = graph_of(shop, "orders")
    # orders 1 and 31 share product and status: two routes of two steps
    found = shortest_path(graph, ("Order", "id=1"), ("Order", "id=31"), 6)
    assert rows(paths_as_result(found)) == [(["Order:id=1", "HAS_PRODUCT", "Product:value=Product 2", "HAS_PRODUCT", "Order:id=31"],)]


def test_bounded(shop):
    df = graph_of(shop, "orders").node("Order")
    assert (bounded(df, 10).row_count, bounded(df, 10).truncated) == (10, True)
    assert (bounded(df, 60).row_count, bounded(df, 60).truncated) == (60, False)
    assert bounded_rows(1000) == 1000
    for n in (-1, 0, 1001):
        with pytest.raises(ValueError):
            bounded_rows(n)


def test_absent_properties_are_left_out(shop):
    stub = graph_of(shop, "orders").node("Customer").withColumn("name", F.lit(None).cast("string"))
    assert nodes_as_result(stub.where("id = 1"), "Customer").first()["node"].asDict(True) == {"label": "Customer", "props": {"id": "1"}}
    assert as_json(stub.where("id = 1").select("id")).first()["row"] == '{"id":1}'


def test_starters(shop):
    orders = graph_of(shop, "orders")
    frames = starter_frames(orders, infer_model(shop["orders"]))
    assert set(frames) == {"rows_per_value", "sharing", "first_paths", "busiest", "shortest_path"}
    assert frames["rows_per_value"]().count() == 3 and frames["shortest_path"]().count() == 1
    items = graph_of(shop, "order_items")
    frames = starter_frames(items, infer_model(shop["order_items"]))
    assert set(frames) == {"busiest", "together", "first_paths", "total"}
    assert frames["first_paths"]().count() == 100 and frames["total"]().count() == 10
    lone = graph_of(shop, "shipments")
    assert set(starter_frames(lone, infer_model(shop["shipments"]))) == {"first_nodes"}


def test_types_shared_by_labels_need_them(spark):
    """Orders and tickets with ids of one name, both with a status: 10 edges of one type, 6 of them orders'."""
    def table(name, n, values, extra):
        data = [(i, values[i % len(values)], *[e[i % len(e)] for e in extra]) for i in range(n)]
        return TableSpec(name, spark.createDataFrame(data, "id int, status string" + ", prio string" * len(extra)), ("id",))

    orders, tickets = table("orders", 6, ["open", "shut"], []), table("tickets", 4, ["open", "open", "open", "shut"], [["lo", "hi", "lo", "lo"]])
    graph = build_graph([(s, infer_model(s)) for s in (orders, tickets)])
    for ask in (
        lambda: expand(graph, graph.node("Order"), "HAS_STATUS"),
        lambda: shared_neighbor_counts(graph, "HAS_STATUS"),
        lambda: count_distinct_neighbors(graph, "HAS_STATUS"),
        lambda: busiest(graph, "HAS_STATUS"),
        lambda: co_occurrence(graph, "HAS_STATUS"),
    ):
        with pytest.raises(ValueError, match="ambiguous"):
            ask()
    assert expand(graph, graph.node("Order"), "HAS_STATUS", from_label="Order").count() == 6
    assert rows(shared_neighbor_counts(graph, "HAS_STATUS", from_label="Order")) == [("value=open", 3), ("value=shut", 3)]
    assert rows(starter_frames(graph, infer_model(orders))["sharing"]()) == [("value=open", 3), ("value=shut", 3)]
    reached = collect_two_hops(graph, "HAS_STATUS", "HAS_PRIO")
    assert rows(reached) == [("value=open", ["hi", "lo"]), ("value=shut", ["lo"])]
    assert rows(busiest(graph, "HAS_STATUS", from_label="Ticket")) == [("value=open", 3), ("value=shut", 1)]


def test_sums_keep_small_values(spark):
    edges = spark.createDataFrame([("a", "x", 0.00004), ("a", "y", 0.00004)], "src_id string, dst_id string, w double")
    graph = PropertyGraph({}, {("A", "R", "B"): edges})
    assert sum_edge_property(graph, "R", "w").first()["total"] == pytest.approx(0.00008)


def test_a_hop_reads_written_steps_only(shop):
    graph = graph_of(shop, "orders")
    steps = stage_table(_both_ways(graph))
    level = steps.limit(1).select("at", F.array().cast("array<struct<label:string,id:string,via:string>>").alias("path"))
    plan = next_level(level, steps, "source")._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan and "Anti" not in plan and plan.count("Relation [") == 2


def test_the_last_hop_is_not_walked(shop, monkeypatch):
    """From an order over a hub to another order: no frontier of all the hub's orders is built."""
    walked, graph = [], graph_of(shop, "orders")
    monkeypatch.setattr(paths, "next_level", lambda level, steps, side: walked.append(side) or next_level(level, steps, side))
    assert shortest_path(graph, ("Order", "id=1"), ("Order", "id=31"), 6).first()["hops"] == 2
    assert len(walked) == 1


def test_paths_into_few_nodes_are_not_sorted(spark, monkeypatch):
    """The steps of a hop's few ends are sent to the paths, though Spark may broadcast nothing of its own."""
    plans = []

    def cut(df):
        if "walked" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df)

    monkeypatch.setattr(paths, "cut_lineage", cut)
    graph = edges_only(spark, [(f"id={i}", f"id={i // 10}") for i in range(1, 200)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = expand_path(graph, graph.node("N"), "R", 1, None)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found.count() == sum(len(str(i)) for i in range(1, 200))
    assert plans and not any("SortMergeJoin" in plan for plan in plans)


def test_co_occurrence_makes_its_edges_once(spark, monkeypatch):
    """Every step reads written edges, not the frame they come from."""
    plans, possible = [], cooccurrence._possible

    def spied(edges, k):
        found = possible(edges, k)
        plans.extend(e._jdf.queryExecution().optimizedPlan().toString() for e in (edges, found[0]))
        return found

    monkeypatch.setattr(cooccurrence, "_possible", spied)
    pairs = [(f"s{s}", f"t{t}") for s in range(12) for t in range(20) if (s * t) % 5 < 3]
    graph = edges_only(spark, pairs)
    key = next(iter(graph.edges))
    graph = PropertyGraph(graph.nodes, {key: graph.edges[key].distinct()})
    assert rows(co_occurrence(graph, "R", 5, hot=2)) == sorted(brute_together(pairs, 5), key=repr)
    assert plans and all(plan.strip().startswith("Relation [") for plan in plans)
