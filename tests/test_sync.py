from dataclasses import replace

from helpers import rows
from pyspark.sql import functions as F

from hubwright.operators.build import build_graph
from hubwright.operators.graph import PropertyGraph
from hubwright.operators.upsert import upsert_edges, upsert_nodes
from hubwright.operators.verify import verdict, verify, verify_full, verify_sample, verify_surplus
from hubwright.plans.model import infer_model
from hubwright.streaming.sync import commit_mark, merge_load, plan_sync, sync_full, sync_incremental


def one(spec):
    return build_graph([(spec, infer_model(spec))])


def same(a, b):
    assert set(a.nodes) == set(b.nodes) and set(a.edges) == set(b.edges)
    for label in a.nodes:
        columns = sorted(a.node(label).columns)
        assert rows(a.node(label).select(*columns)) == rows(b.node(label).select(*columns)), label
    for key in a.edges:
        columns = sorted(a.edges[key].columns)
        assert rows(a.edges[key].select(*columns)) == rows(b.edges[key].select(*columns)), key


def test_upsert_of_itself_changes_nothing(shop):
    graph = one(shop["orders"])
    orders, edges = graph.node("Order"), graph.edge("HAS_STATUS")
    assert rows(upsert_nodes(orders, orders)) == rows(orders)
    assert rows(upsert_edges(edges, edges)) == rows(edges)


def test_upsert_clears_and_keeps(spark):
    old = spark.createDataFrame([("id=1", "a", 1), ("id=2", "b", 2)], "_id string, name string, kept int")
    new = spark.createDataFrame([("id=2", None, 5), ("id=3", "c", 6)], "_id string, name string, added int")
    assert rows(upsert_nodes(old, new)) == [("id=1", "a", 1, None), ("id=2", None, 2, 5), ("id=3", "c", None, 6)]
    stub = spark.createDataFrame([("id=1",)], "_id string")
    assert rows(upsert_nodes(old, stub)) == rows(old)


def test_second_run_changes_nothing(shop):
    for name in ("orders", "order_items", "employees", "shipment_details"):
        spec = shop[name]
        graph = one(spec)
        same(sync_full(graph, spec, infer_model(spec)), graph)


def test_incremental_equals_full(shop):
    spec, model = shop["orders"], infer_model(shop["orders"])
    early = replace(spec, df=spec.df.where("id <= 40"))
    changed = replace(spec, df=spec.df.withColumn("status", F.when(F.col("id") > 35, "shipped").otherwise(F.col("status"))))
    graph = build_graph([(early, model)])
    synced = sync_incremental(graph, changed, model, "id", 36)
    same(synced, build_graph([(changed, model)]))


def test_changed_link_with_and_without_the_old_edge(shop):
    spec, model = shop["orders"], infer_model(shop["orders"])
    moved = replace(spec, df=spec.df.where("id = 1").withColumn("status", F.lit("lost")))
    graph = one(spec)
    mine = F.col("src_id") == "id=1"
    assert [r["dst_id"] for r in merge_load(graph, moved, model).edge("HAS_STATUS").where(mine).collect()] == ["value=lost"]
    assert merge_load(graph, moved, model, replace_for_upserted=False).edge("HAS_STATUS").where(mine).count() == 2


def test_merging_part_of_a_hierarchy_keeps_the_rest(shop):
    spec, model = shop["employees"], infer_model(shop["employees"])
    dev = replace(spec, df=spec.df.where("id = 5").withColumn("manager_id", F.lit(7)))
    merged = merge_load(one(spec), dev, model)
    assert merged.node("Employee").count() == 10
    edges = dict(rows(merged.edge("HAS_MANAGER")))
    assert len(edges) == 8 and edges["id=5"] == "id=7" and edges["id=7"] == "id=3"
    assert merged.node("Employee").where("name IS NULL").count() == 0


def test_marks(spark, shop, tmp_path):
    path = str(tmp_path / "state")
    spec, model = shop["orders"], infer_model(shop["orders"])
    early = replace(spec, df=spec.df.where("id <= 50"))
    first = plan_sync(PropertyGraph(), early, model, path, "id")
    assert (first.mode, first.high_water) == ("full", "50")
    commit_mark(early, path, "id", first)
    second = plan_sync(first.graph, spec, model, path, "id")
    assert (second.mode, second.high_water) == ("incremental(>= 50)", "60")
    same(second.graph, one(spec))
    assert plan_sync(first.graph, spec, model, path, "amount").mode == "full"
    assert plan_sync(first.graph, spec, model, path).high_water is None
    items = shop["order_items"]
    assert plan_sync(one(items), items, infer_model(items), path, "qty").mode == "full"


def test_a_hole_is_found(shop):
    spec, model = shop["orders"], infer_model(shop["orders"])
    graph = one(spec)
    assert verdict(spec.df, graph, model).ok
    holed = graph.with_nodes("Order", graph.node("Order").where("id NOT IN (7, 8)"))
    bad = verdict(spec.df, holed, model)
    assert (bad.ok, bad.source_keys, bad.graph_count, bad.missing) == (False, 60, 58, 2)
    assert rows(verify_full(spec.df, holed, model)) == [("id=7",), ("id=8",)]
    assert tuple(verify_sample(spec.df, holed, model, n=60).first()) == (60, 2)
    assert tuple(verify_sample(spec.df, graph, model, n=10).first()) == (10, 0)


def test_links_are_verified_by_their_ends(shop):
    spec, model = shop["order_items"], infer_model(shop["order_items"])
    graph = one(spec)
    assert verdict(spec.df, graph, model).ok
    key = ("Order", "ORDER_ITEM", "Product")
    holed = graph.with_edges(key, graph.edges[key].where("src_id <> 'id=1'"))
    assert not verdict(spec.df, holed, model).ok
    assert all(r[0] == "id=1" for r in rows(verify_full(spec.df, holed, model)))


def test_hubs_of_the_same_label_do_not_count(shop):
    products = shop["products"]
    graph = build_graph([(shop["orders"], infer_model(shop["orders"])), (products, infer_model(products))])
    assert graph.node("Product").count() == 10
    assert verdict(products.df, graph, infer_model(products)).ok


def test_repeated_rows_and_deletes(shop):
    twice = replace(shop["products"], df=shop["products"].df.unionByName(shop["products"].df), primary_key=())
    model = infer_model(twice)
    row = verify(twice.df, one(twice), model).first()
    assert (row["source_rows"], row["source_keys"], row["graph_count"], row["ok"]) == (10, 5, 5, True)
    assert tuple(verify_sample(twice.df, one(twice), model).first()) == (0, 0)
    orders = shop["orders"]
    assert rows(verify_surplus(orders.df.where("id <> 3"), one(orders), infer_model(orders))) == [("id=3",)]
