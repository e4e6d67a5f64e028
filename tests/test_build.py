from dataclasses import replace
from pathlib import Path

import pytest
from helpers import rows
from pyspark.sql import functions as F

from hubwright.operators.build import build_graph, build_nodes, load_summary, one_per_key, skipped_null_endpoints, wipe_label
from hubwright.operators.graph import union_by_name
from hubwright.plans.model import infer_model
from hubwright.session import drop_staged, stage_table
from hubwright.sources import store
from hubwright.sources.state import read_state, write_state
from hubwright.sources.tables import ForeignKey, TableSpec
from hubwright.sources.store import latest_version, load_saved_graph, save_graph
from hubwright.functions.values import synthetic_key, to_graph_value


def graph_of(shop, *names):
    return build_graph([(shop[n], infer_model(shop[n])) for n in names])


def counts(graph):
    return {(r["kind"], r["name"]): r["count"] for r in load_summary(graph).collect()}


def test_orders_graph(shop):
    found = counts(graph_of(shop, "orders"))
    assert found == {
        ("node", "Order"): 60, ("node", "Customer"): 8, ("node", "Status"): 3, ("node", "Product"): 5,
        ("edge", "HAS_CUSTOMER"): 60, ("edge", "HAS_STATUS"): 60, ("edge", "HAS_PRODUCT"): 60,
    }


def test_stubs_are_filled_by_their_table(shop):
    graph = graph_of(shop, "orders", "customers")
    customers = graph.node("Customer")
    assert customers.count() == 12
    assert customers.where("name IS NULL").count() == 0
    reverse = graph_of(shop, "customers", "orders")
    assert rows(reverse.node("Customer")) == rows(customers)


def test_dangling_references_stay_as_stubs(spark, shop):
    few = replace(shop["customers"], df=shop["customers"].df.where("id <= 3"))
    graph = build_graph([(shop["orders"], infer_model(shop["orders"])), (few, infer_model(few))])
    assert graph.node("Customer").where("name IS NULL").count() == 5


def test_link_table_edges(shop):
    graph = graph_of(shop, "order_items")
    assert counts(graph)[("edge", "ORDER_ITEM")] == 100
    per_product = graph.edge("ORDER_ITEM").groupBy("dst_id").count().collect()
    assert [r["count"] for r in per_product] == [20] * 5


def test_composite_reference_is_one_edge(shop):
    graph = graph_of(shop, "shipments", "shipment_details")
    edges = rows(graph.edge("HAS_SHIPMENT"))
    assert edges == [
        ('{"region":"EU","seq":1}', '{"region":"EU","seq":1}'),
        ('{"region":"US","seq":1}', '{"region":"US","seq":1}'),
    ]
    assert graph.node("Shipment").count() == 3 and graph.node("ShipmentDetail").count() == 2


def test_two_keys_under_one_label_do_not_mix(shop):
    parts = graph_of(shop, "orders", "order_items", "products").node("Product")
    assert {r["_key"]: r["count"] for r in parts.groupBy("_key").count().collect()} == {"id": 5, "value": 5}


def test_rebuilding_gives_the_same_graph(shop):
    a, b = graph_of(shop, "orders", "employees"), graph_of(shop, "orders", "employees")
    for label in a.nodes:
        assert rows(a.node(label)) == rows(b.node(label))
    for key in a.edges:
        assert rows(a.edges[key]) == rows(b.edges[key])


def test_copies_of_a_key_resolve_the_same_way_every_time(spark, shop):
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "id int, name string").repartition(3)
    model = infer_model(shop["products"])
    assert rows(build_nodes(twice, model)) == [("id=1", "id", 1, "b"), ("id=2", "id", 2, "c")]


def test_equal_rows_without_key_become_one_node(spark, shop):
    spec = replace(shop["products"], df=shop["products"].df.unionByName(shop["products"].df), primary_key=())
    model = infer_model(spec)
    plain, staged = build_graph([(spec, model)]), build_graph([(spec, model)], stage=stage_table)
    assert plain.node("Product").count() == 5
    assert rows(plain.node("Product")) == rows(staged.node("Product").select(*plain.node("Product").columns))
    for key in plain.edges:
        assert rows(plain.edges[key]) == rows(staged.edges[key])


def test_row_hash_is_framed(spark):
    df = spark.createDataFrame([("1", "11"), ("11", "1"), (None, "-"), ("-", None), ("1", "1,1:1")], "a string, b string")
    keys = df.select(synthetic_key([(F.col(f.name), f.dataType) for f in df.schema.fields]).alias("k"))
    assert keys.distinct().count() == 5


def test_values(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-01-02 03:04:05.06' AS a, timestamp'2024-01-02 03:04:05' AS b, date'2024-01-02' AS c,"
        " 1.50BD AS d, X'0aFF' AS e, array(1, 2) AS f, 7 AS g, timestamp_ntz'2024-01-02 03:04:05' AS h"
    )
    out = df.select(*[to_graph_value(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]).first()
    assert tuple(out) == (
        "2024-01-02T03:04:05.060000", "2024-01-02T03:04:05+00:00", "2024-01-02", 1.5, "0aff", "[1,2]", 7, "2024-01-02T03:04:05",
    )


def test_null_ends_of_links(spark, shop):
    items = shop["order_items"]
    holed = replace(items, df=items.df.withColumn("product_id", F.when(F.col("qty") > 1, F.col("product_id"))))
    model = infer_model(holed)
    kept = items.df.where("qty > 1").count()
    assert tuple(skipped_null_endpoints(holed.df, model).first()) == (100, 100 - kept)
    assert build_graph([(holed, model)]).edge("ORDER_ITEM").count() == kept


def test_wipe(shop):
    graph = wipe_label(graph_of(shop, "orders"), "Order")
    assert set(graph.nodes) == {"Customer", "Status", "Product"} and not graph.edges


def test_type_clashes(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2**40,)], "x bigint")
    assert rows(union_by_name([a, b])) == [(1,), (2**40,)]
    with pytest.raises(TypeError, match="column x"):
        union_by_name([a, spark.createDataFrame([("t",)], "x string")])


def test_unknown_names_are_errors(shop):
    graph = graph_of(shop, "orders")
    with pytest.raises(KeyError, match="no label"):
        graph.node("Nope")
    with pytest.raises(KeyError, match="no edges"):
        graph.edge("NOPE")


def test_saved_versions(spark, shop, tmp_path):
    path = str(tmp_path / "graph")
    assert latest_version(spark, path) == 0
    with pytest.raises(FileNotFoundError):
        load_saved_graph(spark, path)
    graph = graph_of(shop, "orders", "order_items")
    assert save_graph(graph, path) == 1
    loaded = load_saved_graph(spark, path)
    assert counts(loaded) == counts(graph)
    # the next version is made from the one that is read
    assert save_graph(wipe_label(loaded, "Status"), path) == 2
    assert "Status" not in load_saved_graph(spark, path).nodes
    assert "Status" in load_saved_graph(spark, path, version=1).nodes


def test_state(spark, tmp_path):
    path = str(tmp_path / "state")
    assert rows(read_state(spark, path)) == []
    write_state(spark, path, "orders", "updated", "2024-01-01")
    write_state(spark, path, "items", "id", "5")
    write_state(spark, path, "orders", "updated", "2024-02-01")
    found = {r["source_table"]: r["high_water"] for r in read_state(spark, path).collect()}
    assert found == {"orders": "2024-02-01", "items": "5"}
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part-0.parquet").write_text("junk")
    assert rows(read_state(spark, str(bad))) == []


def test_reserved_names_of_columns_are_kept_apart(spark):
    """The usual key of a document store, and columns named like the ends of edges."""
    df = spark.createDataFrame([(1, "a", "x", "n"), (2, "b", "y", "n")], "id int, _id string, src_id string, name string")
    by_id = TableSpec("things", df, ("_id",), (ForeignKey("f", ("src_id",), "others", ("_id",)),))
    graph = build_graph([(by_id, infer_model(by_id))])
    assert rows(graph.node("Thing").select("_id", "id", "_id_")) == [("_id_=a", 1, "a"), ("_id_=b", 2, "b")]
    (edges,) = graph.edges.values()
    assert rows(edges.select("src_id", "dst_id")) == [("_id_=a", "_id_=x"), ("_id_=b", "_id_=y")]


def test_two_keys_to_one_parent_are_told_apart(spark):
    df = spark.createDataFrame([(1, "EU", 1, "US", 2)], "id int, sr string, sn int, br string, bn int")
    keys = tuple(ForeignKey(n, c, "addresses", ("r", "n")) for n, c in (("ship", ("sr", "sn")), ("bill", ("br", "bn"))))
    spec = TableSpec("orders", df, ("id",), keys)
    graph = build_graph([(spec, infer_model(spec))])
    assert {k[1] for k in graph.edges} == {"HAS_SHIP", "HAS_BILL"}
    assert graph.edge("HAS_SHIP").first()["dst_id"] != graph.edge("HAS_BILL").first()["dst_id"]


def test_map_columns_keep_the_same_row(spark):
    df = spark.sql("SELECT id % 2 AS k, map('a', id) AS m FROM range(40)").repartition(7)
    first = {r["k"]: r["m"] for r in one_per_key(df, ["k"]).collect()}
    assert first == {r["k"]: r["m"] for r in one_per_key(df.repartition(3), ["k"]).collect()} == {0: {"a": 8}, 1: {"a": 9}}


def test_unchanged_tables_keep_their_files(spark, shop, tmp_path):
    path = str(tmp_path / "graph")
    save_graph(graph_of(shop, "orders"), path)
    loaded = load_saved_graph(spark, path)
    before = {k: f.inputFiles() for k, f in loaded.nodes.items()}
    fewer = loaded.with_nodes("Order", loaded.node("Order").where("id > 5"))
    assert save_graph(fewer, path) == 2
    after = load_saved_graph(spark, path)
    assert {k for k, f in after.nodes.items() if f.inputFiles() != before[k]} == {"Order"}
    assert after.node("Order").count() == 55


def test_of_two_writers_one_fails(spark, shop, tmp_path, monkeypatch):
    path = str(tmp_path / "graph")
    graph = graph_of(shop, "orders")
    save_graph(graph, path)
    monkeypatch.setattr(store, "latest_version", lambda spark, path: 0)
    kept = {r["commit"] for r in spark.read.parquet(f"{path}/versions").collect()}
    monkeypatch.setattr(store.uuid, "uuid4", lambda: type("U", (), {"hex": "f" * 32})())
    with pytest.raises(RuntimeError, match="version 1"):
        save_graph(graph.with_nodes("Order", graph.node("Order").limit(1)), path)
    monkeypatch.undo()
    assert load_saved_graph(spark, path).node("Order").count() == 60 and len(kept) == 1


def test_staged_tables_can_be_dropped(spark):
    staged = stage_table(spark.range(3))
    assert staged.count() == 3
    folder = Path(staged.inputFiles()[0].removeprefix("file://")).parent.parent
    assert folder.exists()
    drop_staged(spark)
    assert not folder.exists()
