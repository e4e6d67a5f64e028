"""Numbered, bucketed edges."""

import re

import pytest
from helpers import rows
from pyspark.sql import functions as F

from hubwright.operators.adjacency import IN, OUT, build_adjacency, number_nodes, two_hops
from hubwright.operators.build import build_graph
from hubwright.operators.graph import PropertyGraph
from hubwright.plans.model import infer_model

PLACED, STATUS = ("Order", "HAS_CUSTOMER", "Customer"), ("Order", "HAS_STATUS", "Status")


def test_numbers_are_dense_and_ordered(spark):
    frame = spark.range(1000).selectExpr("concat('id=', id) AS _id").repartition(7)
    numbered = number_nodes(frame).collect()
    assert [r.node for r in sorted(numbered)] == list(range(1000))
    assert number_nodes(frame.where("false")).collect() == []


@pytest.mark.parametrize("least_hot", [1 << 16, 3])
def test_two_hops_equal_joins(spark, shop, least_hot):
    """Customers to the statuses of their orders, with ordinary buckets and with every node hot."""
    graph = build_graph([(shop[n], infer_model(shop[n])) for n in ("orders", "customers")])
    made = build_adjacency(graph, [PLACED, STATUS], bucket_edges=20, least_hot=least_hot)
    got = two_hops(made, graph.node("Customer"), (PLACED, IN), (STATUS, OUT))
    a, b = graph.edges[PLACED], graph.edges[STATUS].select("src_id", F.col("dst_id").alias("end_id"))
    want = a.join(b, "src_id").select(F.col("dst_id").alias("start_id"), "end_id").distinct()
    assert rows(got.select("start_id", "end_id")) == rows(want) and got.count() > 20
    made.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("adjacency_")]


def test_edges_are_not_shuffled(spark):
    """Between a scan of edges and its join there is no exchange, even where nothing may be broadcast."""
    nodes = spark.range(3000).selectExpr("concat('id=', id) AS _id")
    edges = spark.range(20000).selectExpr("concat('id=', id % 3000) AS src_id", "concat('id=', id * 7 % 3000) AS dst_id").distinct()
    key = ("N", "TO", "N")
    made = build_adjacency(PropertyGraph({"N": nodes}, {key: edges}), [key], bucket_edges=5000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = two_hops(made, nodes, (key, OUT), (key, OUT))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scans = [i for i, line in enumerate(plan.splitlines()) if "Scan parquet" in line and "adjacency_" in line]
    assert len(scans) == 2
    lines = plan.splitlines()
    for i in scans:
        assert "Bucketed: true" in lines[i]
        depth = len(re.match(r"[\s:|+\-*()\d]*", lines[i]).group())
        for line in reversed(lines[:i]):
            own = len(re.match(r"[\s:|+\-*()\d]*", line).group())
            if own < depth:
                assert "Exchange" not in line
                depth = own
                if "Join" in line:
                    break
    made.drop()


def test_a_hot_node_lies_in_several_parts(spark):
    nodes = spark.range(2001).selectExpr("concat('id=', id) AS _id")
    edges = spark.range(1, 2001).selectExpr("concat('id=', id) AS src_id", "'id=0' AS dst_id")
    key = ("N", "TO", "N")
    made = build_adjacency(PropertyGraph({"N": nodes}, {key: edges}), [key], bucket_edges=500, least_hot=100)
    parts = spark.table(made.tables[key, IN]).groupBy("part").count().collect()
    assert len(parts) == 20 and max(r["count"] for r in parts) < 200
    start = made.numbers(nodes.where("_id = 'id=0'"), "N")
    assert made.step(start, key, IN, "node", "other").count() == 2000
    made.drop()


def test_buckets_do_not_grow_with_the_edges(spark):
    nodes = spark.range(300).selectExpr("concat('id=', id) AS _id")
    edges = spark.range(300).selectExpr("concat('id=', id) AS src_id", "concat('id=', id * 7 % 300) AS dst_id")
    key = ("N", "TO", "N")
    made = build_adjacency(PropertyGraph({"N": nodes}, {key: edges}), [key], bucket_edges=2)
    for direction in (IN, OUT):
        table = spark.sql(f"DESCRIBE EXTENDED {made.tables[key, direction]}").where("col_name = 'Num Buckets'")
        assert table.first()["data_type"] == "64"
        assert spark.table(made.tables[key, direction]).count() == 300
    made.drop()
