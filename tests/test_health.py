from helpers import rows
from pyspark.sql import functions as F

from hubwright.operators import digest, health
from hubwright.operators.build import build_graph
from hubwright.operators.graph import PropertyGraph
from hubwright.operators.snapshot import snapshot, snapshot_sink
from hubwright.plans.model import infer_model


def graph_of(shop, *names):
    return build_graph([(shop[n], infer_model(shop[n])) for n in names])


def test_orphan(shop):
    graph = graph_of(shop, "employees")
    assert rows(health.orphans(graph)) == [("Employee", 1)]
    assert rows(health.degrees(graph).where("degree = 0").select("_id")) == [("id=10",)]


def test_self_loop_counts_once(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "_id string")
    edges = spark.createDataFrame([("a", "a"), ("a", "b")], "src_id string, dst_id string")
    graph = PropertyGraph({"N": nodes}, {("N", "R", "N"): edges})
    assert rows(health.degrees(graph)) == [("N", "a", 2), ("N", "b", 1)]


def test_hubs(shop):
    hubs = health.top_hubs(graph_of(shop, "orders"), 2)
    status = rows(hubs.where("label = 'Status'").select("rank", "degree", "ident"))
    assert status == [(1, 20, ["value=cancelled"]), (2, 20, ["value=pending"])]


def test_collision_is_reported(shop):
    graph = graph_of(shop, "orders", "order_items", "products")
    assert rows(health.mixed_key_shapes(graph).select("label", "shapes", "nodes")) == [("Product", 2, 10)]
    assert rows(health.mixed_key_shapes(graph_of(shop, "orders", "customers"))) == []


def test_part_shapes_fold_into_the_largest(spark):
    data = [(1, "a", None, None), (2, None, None, None), (3, None, "x", None), (4, None, None, None), (5, "b", "y", None), (6, None, None, "z")]
    nodes = spark.createDataFrame(data, "id int, p string, q string, r string").withColumn("_id", F.col("id").cast("string"))
    graph = PropertyGraph({"N": nodes}, {})
    assert rows(health.key_shapes(graph)) == [("N", ["id", "p", "q"], 5), ("N", ["id", "r"], 1)]
    bare = PropertyGraph({"N": nodes.select("_id", F.when(F.col("id") > 3, F.col("id")).alias("id"))}, {})
    assert rows(health.key_shapes(bare)) == [("N", ["id"], 6)]


def test_findings(spark, shop):
    graph = graph_of(shop, "orders")
    assert rows(health.supernodes(graph, degree=19)) == [("Status", 3, 20)]
    assert rows(health.supernodes(graph)) == []
    assert rows(health.missing_key_check(graph, ["Order"], above=10)) == []
    assert rows(health.missing_key_check(graph, [], above=10)) == [("Order", 60, False, 0)]
    doubled = graph.with_nodes("Order", graph.node("Order").unionByName(graph.node("Order").where("id = 1")))
    assert rows(health.missing_key_check(doubled, ["Order"], above=10)) == [("Order", 61, True, 1)]
    named = PropertyGraph({"Node": graph.node("Status")}, {("Node", "HAS", "Node"): graph.edge("HAS_STATUS")})
    assert rows(health.generic_names(named)) == [("label", "Node", 3), ("type", "HAS", 60)]


def test_guard(shop):
    graph = graph_of(shop, "orders")
    scanned, skipped = health.guarded(graph, 50)
    assert "Order" not in scanned.nodes and rows(skipped) == [("Order", 60)]
    report = health.health(graph, max_nodes=50)
    assert rows(report["degree_scan_skipped"]) == [("Order", 60)]
    assert {r["label"] for r in report["orphans"].collect()} == {"Customer", "Status", "Product"}
    assert rows(health.guarded(graph)[1]) == []


def test_digest(shop):
    found = digest.digest(graph_of(shop, "orders"))
    assert rows(found["labels"]) == [("Customer", 8), ("Order", 60), ("Product", 5), ("Status", 3)]
    assert rows(found["dimension_values"].where("label = 'Status'")) == [("Status", ["cancelled", "pending", "shipped"])]
    assert dict(rows(found["properties"]))["Order"] == ["amount", "created_at", "id"]
    assert found["patterns"].first()["count"] == 60
    assert {r["label"] for r in digest.dimension_values(graph_of(shop, "orders"), 4).collect()} == {"Status"}
    import hashlib

    text = "Customer:8|Order:60|Product:5|Status:3"
    assert found["fingerprint"].first()[0] == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_snapshot(shop, tmp_path):
    graph = graph_of(shop, "orders")
    whole = snapshot(graph)
    assert tuple(whole.flags.first()) == (76, 180, False, False)
    assert whole.nodes.count() == 76 and whole.links.count() == 180
    cut = snapshot(graph, max_nodes=20, max_edges=5)
    assert cut.nodes.count() == 20 and cut.links.count() == 5
    flags = cut.flags.first()
    assert flags["nodes_sampled"] and flags["edges_sampled"]
    kept = {(r["label"], r["_id"]) for r in cut.nodes.collect()}
    assert all((r["from_label"], r["src_id"]) in kept and (r["to_label"], r["dst_id"]) in kept for r in cut.links.collect())
    assert sum(r["nodes"] for r in cut.legend.collect()) == 20
    snapshot_sink(cut, str(tmp_path / "cut"))
    assert sorted(p.name for p in (tmp_path / "cut").iterdir()) == ["flags", "legend", "links", "nodes"]


def test_long_values_are_cut(spark):
    nodes = spark.createDataFrame([("a", "x" * 121, "y" * 120)], "_id string, long string, fits string")
    graph = PropertyGraph({"N": nodes}, {})
    props = {p["key"]: p["value"] for p in snapshot(graph).nodes.first()["props"]}
    assert props == {"long": "x" * 120 + "…", "fits": "y" * 120}
