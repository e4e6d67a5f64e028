"""Registered queries and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, twin: str | None = None):
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if twin is not None:
            TWINS[name] = twin
        return run

    return register


# The sales graph as SQL: nodes(label, _id) and edges(from_label, src_id, type, to_label, dst_id).
SALES = """
WITH nodes AS (
  SELECT 'Region' AS label, 'r_regionkey=' || r_regionkey AS _id FROM region
  UNION ALL SELECT 'Nation', 'n_nationkey=' || n_nationkey FROM nation
  UNION ALL SELECT 'Customer', 'c_custkey=' || c_custkey FROM customer
  UNION ALL SELECT 'Order', 'o_orderkey=' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'CMktsegment', 'value=' || c_mktsegment FROM customer
  UNION ALL SELECT DISTINCT 'OOrderstatus', 'value=' || o_orderstatus FROM orders
  UNION ALL SELECT DISTINCT 'OOrderpriority', 'value=' || o_orderpriority FROM orders
), edges AS (
  SELECT 'Nation' AS from_label, 'n_nationkey=' || n_nationkey AS src_id, 'HAS_N_REGIONKEY' AS type,
         'Region' AS to_label, 'r_regionkey=' || n_regionkey AS dst_id FROM nation
  UNION ALL SELECT 'Customer', 'c_custkey=' || c_custkey, 'HAS_C_NATIONKEY', 'Nation', 'n_nationkey=' || c_nationkey FROM customer
  UNION ALL SELECT 'Customer', 'c_custkey=' || c_custkey, 'HAS_C_MKTSEGMENT', 'CMktsegment', 'value=' || c_mktsegment FROM customer
  UNION ALL SELECT 'Order', 'o_orderkey=' || o_orderkey, 'HAS_O_CUSTKEY', 'Customer', 'c_custkey=' || o_custkey FROM orders
  UNION ALL SELECT 'Order', 'o_orderkey=' || o_orderkey, 'HAS_O_ORDERSTATUS', 'OOrderstatus', 'value=' || o_orderstatus FROM orders
  UNION ALL SELECT 'Order', 'o_orderkey=' || o_orderkey, 'HAS_O_ORDERPRIORITY', 'OOrderpriority', 'value=' || o_orderpriority FROM orders
), degrees AS (
  SELECT n.label, n._id, CAST(count(e.other) AS BIGINT) AS degree
  FROM nodes n LEFT JOIN (
    SELECT from_label AS label, src_id AS _id, dst_id AS other FROM edges
    UNION ALL SELECT to_label, dst_id, src_id FROM edges
  ) e ON n.label = e.label AND n._id = e._id
  GROUP BY n.label, n._id
)
"""
