from dataclasses import replace

import pytest
from helpers import rows

from hubwright.plans.model import (
    DIMENSION, Relationship, infer_model, is_join_table, load_model, save_model,
)
from hubwright.plans.profile import dimension_columns, distinct_cap, profile_columns
from hubwright.sources.tables import ForeignKey, TableSpec, check_foreign_key, check_primary_key, describe_columns, scan_table


def test_orders_become_nodes_with_hubs(shop):
    model = infer_model(shop["orders"])
    assert (model.label, model.key, model.synthetic) == ("Order", ("id",), False)
    assert model.properties == ("id", "amount", "created_at")
    assert [(r.kind, r.rel_type, r.to_label, r.to_key) for r in model.relationships] == [
        ("foreign_key", "HAS_CUSTOMER", "Customer", ("id",)),
        ("dimension", "HAS_STATUS", "Status", ("value",)),
        ("dimension", "HAS_PRODUCT", "Product", ("value",)),
    ]
    assert [r.distinct_values for r in model.relationships] == [None, 3, 5]


def test_link_table(shop):
    model = infer_model(shop["order_items"])
    assert is_join_table(shop["order_items"])
    assert (model.from_label, model.rel_type, model.to_label) == ("Order", "ORDER_ITEM", "Product")
    assert model.properties == ("qty", "unit_price")


def test_detail_table_is_no_link_table(shop):
    model = infer_model(shop["shipment_details"])
    assert not is_join_table(shop["shipment_details"])
    assert [(r.rel_type, r.to_label, r.to_key) for r in model.relationships] == [("HAS_SHIPMENT", "Shipment", ("region", "seq"))]
    assert model.properties == ("region", "seq", "note")


def test_self_reference(shop):
    (rel,) = infer_model(shop["employees"]).relationships
    assert rel.self_reference and rel.rel_type == "HAS_MANAGER" and rel.to_label == "Employee"


def test_table_without_key(shop):
    model = infer_model(replace(shop["products"], primary_key=()))
    assert model.key == ("_row_key",) and model.key_from == ("id", "name")


def test_empty_table_has_no_hubs(spark):
    empty = spark.createDataFrame([], "id int, status string")
    assert infer_model(TableSpec("t", empty, ("id",))).relationships == ()
    assert rows(profile_columns(empty)) == [("status", 0, 0)]


def test_cap():
    assert [distinct_cap(n) for n in (1, 60, 250, 499, 500, 10**9)] == [20, 20, 25, 49, 50, 50]


@pytest.mark.parametrize("distinct, hub", [(1, False), (2, True), (50, True), (51, False), (1000, False)])
def test_hubs_around_the_cap(spark, distinct, hub):
    df = spark.range(1000).selectExpr("id", f"cast(id % {distinct} as string) AS v", "cast(NULL as string) AS nothing", "id % 2 = 0 AS flag")
    found = {r["column"]: r["distinct_values"] for r in dimension_columns(df).collect()}
    assert found == ({"v": distinct, "flag": 2} if hub else {"flag": 2})


def test_a_cap_too_high_to_screen(spark):
    df = spark.range(10000).selectExpr("cast(id % 3000 as string) AS v", "cast(id as string) AS own")
    assert rows(dimension_columns(df, max_distinct=5000, ratio=0.5)) == [("v", 3000, 10000)]


def test_long_values_count_as_they_are(spark):
    df = spark.range(300).selectExpr("concat(repeat('x', 100), id % 7) AS v", "if(id % 2 = 0, NULL, repeat('y', 64)) AS w")
    assert rows(profile_columns(df)) == [("v", 7, 300), ("w", 1, 300)]


def test_unique_column_is_no_hub(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "v string")
    assert rows(dimension_columns(df)) == []


def test_editing(shop):
    model = infer_model(shop["orders"])
    edited = model.rename("Purchase", {"HAS_CUSTOMER": "PLACED_BY"}, {"Product": "Article"})
    assert edited.label == "Purchase" and [r.rel_type for r in edited.relationships][0] == "PLACED_BY"
    assert edited.relationships[2].to_label == "Article"
    dropped = model.drop("HAS_STATUS")
    assert "status" in dropped.properties and len(dropped.relationships) == 2
    added = dropped.add(Relationship(DIMENSION, "HAS_STATUS", "Status", ("status",), ("value",)))
    assert "status" not in added.properties and len(added.relationships) == 3
    with pytest.raises(KeyError):
        model.drop("NOPE")
    with pytest.raises(KeyError):
        model.rename(rel_types={"NOPE": "X"})


def test_saved_models_are_equal(shop, tmp_path):
    for name in ("orders", "order_items", "employees", "shipment_details"):
        model = infer_model(shop[name])
        save_model(model, tmp_path / "model.json")
        assert load_model(tmp_path / "model.json") == model


def test_specs_reject_unknown_columns(spark, shop):
    df = shop["orders"].df
    with pytest.raises(ValueError, match="no column"):
        TableSpec("orders", df, ("nope",))
    with pytest.raises(ValueError, match="pair up"):
        ForeignKey("f", ("a", "b"), "t", ("a",))
    with pytest.raises(ValueError, match="no such column"):
        scan_table(df, ["nope"])
    assert [tuple(r) for r in describe_columns(df).limit(2).collect()] == [(1, "id", "int", True), (2, "customer_id", "int", True)]


def test_key_checks(spark):
    parent = TableSpec("p", spark.createDataFrame([(1, 1), (1, 2)], "a int, b int"), ("a", "b"))
    child_df = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, 2), (None, 2)], "x int, y int")
    fk = ForeignKey("f", ("x", "y"), "p", ("a", "b"))
    child = TableSpec("c", child_df, ("x", "y"), (fk,))
    assert rows(check_primary_key(parent)) == []
    assert rows(check_primary_key(child)) == [(1, 1, 2), (2, 2, 2), (None, 2, 1)]
    assert rows(check_foreign_key(child, fk, parent)) == [(2, 2, 2)]
