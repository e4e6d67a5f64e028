"""Profiles, degrees and pattern counts that are brought up to date from changes."""

from dataclasses import replace

import pytest
from helpers import rows
from pyspark.sql import functions as F

from hubwright.operators import changes
from hubwright.operators.build import build_graph
from hubwright.operators.digest import label_counts, pattern_counts
from hubwright.operators.health import degrees
from hubwright.plans import sketch
from hubwright.plans.model import infer_model
from hubwright.plans.profile import dimension_columns, profile_columns
from hubwright.streaming.sync import merge_load


def plain(state):
    return sorted((r["column"], r["row_count"], r["values"]) for r in state.collect())


def wide(spark, lo, hi):
    return spark.range(lo, hi).selectExpr(
        "id", "concat('s', id % 7) AS few", "concat('m', id % 60) AS some", "concat('x', id) AS many", "id % 2 = 0 AS flag",
        "if(id % 3 = 0, repeat('long ', 30) || id % 4, null) AS texts", "cast(null as string) AS nothing",
    )


def test_state_after_deltas_equals_a_new_one(spark, tmp_path):
    whole, path = wide(spark, 0, 3000), f"file://{tmp_path}/state"
    for lo, hi in ((0, 1000), (1000, 1001), (1001, 3000), (5, 5)):
        sketch.save_state(sketch.profile_state(wide(spark, lo, hi), kept=100), path)
    kept, new = sketch.load_state(spark, path, kept=100), sketch.profile_state(whole, kept=100)
    assert plain(kept) == plain(new)
    got = {r["column"]: r for r in sketch.distinct_of(kept).collect()}
    for r in profile_columns(whole).collect():
        assert got[r["column"]]["row_count"] == r["row_count"]
        exact = got[r["column"]]["exact"]
        assert exact == (r["distinct_values"] <= 100)
        assert abs(got[r["column"]]["distinct_values"] - r["distinct_values"]) <= (0 if exact else 0.1 * r["distinct_values"])
    assert rows(sketch.dimension_columns_of(kept, kept=100)) == rows(dimension_columns(whole))
    assert rows(sketch.dimension_columns_of(kept, ["few"], 70, kept=100)) == rows(dimension_columns(whole, ["few"], 70))
    with pytest.raises(ValueError, match="cannot decide"):
        sketch.dimension_columns_of(kept, max_distinct=101, kept=100)


def test_a_table_without_text_has_an_empty_state(spark):
    assert sketch.profile_state(spark.range(3)).collect() == []
    assert plain(sketch.profile_state(wide(spark, 0, 0)))[0][1:] == (0, [])


@pytest.mark.parametrize(("name", "replaced"), [("orders", True), ("orders", False), ("employees", True), ("order_items", True)])
def test_counts_after_an_upsert_with_moved_links(spark, shop, name, replaced):
    spec, model = shop[name], infer_model(shop[name])
    graph = build_graph([(shop[n], infer_model(shop[n])) for n in ("orders", "employees", "order_items", "customers")])
    if name == "orders":
        moved = spec.df.where("id in (1, 2, 30)").withColumn("status", F.lit("lost")).withColumn("customer_id", F.expr("if(id = 2, 77, 3)"))
        moved = moved.union(spec.df.where("id = 5").withColumn("id", F.lit(500)))
    elif name == "employees":
        moved = spec.df.where("id in (3, 5, 10)").withColumn("manager_id", F.expr("if(id = 10, 10, if(id = 5, null, 4))"))
    else:
        moved = spec.df.limit(4).withColumn("product_id", F.col("product_id") + 1)
    delta = replace(spec, df=moved)
    found = changes.load_changes(graph, delta, model, replaced)
    after = merge_load(graph, delta, model, replaced)
    assert rows(changes.apply_to_degrees(degrees(graph), found)) == rows(degrees(after).select("label", "_id", "degree"))
    assert rows(changes.apply_to_patterns(pattern_counts(graph), found)) == rows(pattern_counts(after))
    assert rows(changes.apply_to_label_counts(label_counts(graph), found)) == rows(label_counts(after))


def test_nothing_changes_where_nothing_is_new(shop):
    spec, model = shop["orders"], infer_model(shop["orders"])
    graph = build_graph([(spec, model)])
    found = changes.load_changes(graph, spec, model)
    assert all(f.isEmpty() for f in [*found.edges.values(), *found.nodes.values()])
