"""Plans at scale: what reaches the scan, what is shuffled, where groups are cut down."""

import pytest
from workloads import tables as t

from hubwright.operators import dedupe, health
from hubwright.operators.build import build_edges, build_nodes
from hubwright.streaming.sync import changed_rows

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark):
    return t.spec(spark, SF, "orders"), t.model(spark, SF, "orders")


def test_building_from_an_enforced_key_never_shuffles(orders):
    spec, model = orders
    frames = [build_nodes(spec.df, model, unique=True)] + [build_edges(spec.df, model, r, unique=True) for r in model.relationships]
    assert not any("Exchange" in plan(f) for f in frames)


def test_edges_read_only_their_columns(orders):
    spec, model = orders
    text = plan(build_edges(spec.df, model, model.relationships[1], unique=True))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text
    assert "IsNotNull(o_orderstatus)" in text


def test_the_mark_reaches_the_scan(orders):
    spec, _ = orders
    assert "GreaterThanOrEqual(o_orderdate" in plan(changed_rows(spec.df, "o_orderdate", "1998-01-01T00:00:00"))


def test_degrees_take_one_shuffle(spark):
    text = plan(health.degrees(t.graph(spark, SF)).select("label", "_id", "degree"))
    # hubs are made distinct first, all else meets in one exchange
    assert text.count("Exchange hashpartitioning(label") == 1 and "Join" not in text


def test_ranks_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(health.top_degrees(t.graph(spark, SF)))


def test_a_hub_of_many_rows_is_counted_before_the_join(spark):
    from hubwright.operators.match import count_per_target

    text = plan(count_per_target(t.graph(spark, SF), "Order", "HAS_O_ORDERSTATUS", "OOrderstatus"))
    assert "partial_count" in text


def test_copies_are_numbered_within_shards(spark):
    nodes = dedupe.candidates(t.graph(spark, SF, ("documents",)).node("Document"), "text")
    text = plan(dedupe.numbered_copies(nodes))
    assert "row_number() windowspecdefinition(form" in text and "shard" in text


def test_a_small_delta_does_not_shuffle_the_old_nodes(spark, orders):
    from hubwright.operators.upsert import upsert_nodes

    spec, model = orders
    old = build_nodes(spec.df, model, unique=True)
    delta = build_nodes(spec.df.where("o_orderdate >= '2001-07-31'"), model, unique=True)
    assert "BroadcastHashJoin" in plan(upsert_nodes(old, delta)) and "SortMergeJoin" not in plan(upsert_nodes(old, delta))


def test_pairs_are_cut_to_the_cap_before_the_shuffle(spark, monkeypatch):
    plans = []

    def noted(df):
        plans.append(plan(df))
        return df.checkpoint()

    monkeypatch.setattr(dedupe, "cut_lineage", noted)
    people = spark.createDataFrame([(f"id={i}", f"Customer {i}") for i in range(6)], "_id string, name string")
    assert dedupe.find_duplicates(dedupe.candidates(people, "name"), cap=3).count() > 0
    assert any("WindowGroupLimit" in p for p in plans)
