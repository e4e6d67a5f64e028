"""The test tables with their declared keys, and the graphs the queries run on."""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from hubwright.operators.build import build_graph
from hubwright.operators.graph import PropertyGraph
from hubwright.plans.model import Model, infer_model
from hubwright.sources.tables import ForeignKey, TableSpec

# table -> (primary key, foreign keys as (columns, referenced table, referenced columns))
DECLARED = {
    "region": (("r_regionkey",), ()),
    "nation": (("n_nationkey",), ((("n_regionkey",), "region", ("r_regionkey",)),)),
    "customer": (("c_custkey",), ((("c_nationkey",), "nation", ("n_nationkey",)),)),
    "supplier": (("s_suppkey",), ((("s_nationkey",), "nation", ("n_nationkey",)),)),
    "part": (("p_partkey",), ()),
    "orders": (("o_orderkey",), ((("o_custkey",), "customer", ("c_custkey",)),)),
    "lineitem": (
        (),
        (
            (("l_orderkey",), "orders", ("o_orderkey",)),
            (("l_partkey",), "part", ("p_partkey",)),
            (("l_suppkey",), "supplier", ("s_suppkey",)),
        ),
    ),
    "events": (("event_id",), ((("user_id",), "customer", ("c_custkey",)),)),
    "documents": (("doc_id",), ()),
    "labels": (("doc_id",), ((("doc_id",), "documents", ("doc_id",)),)),
    "pages": (("page_id",), ()),
    "conversations": (("conv_id", "turn"), ()),
    "benchmark": (("item_id",), ()),
    "embeddings": (("vec_id",), ()),
}

SALES = ("region", "nation", "customer", "orders")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spec(spark: SparkSession, sf_dir: str, name: str, df: DataFrame | None = None) -> TableSpec:
    """A test table with its keys, all of which its writer guarantees."""
    key, foreign = DECLARED[name]
    keys = tuple(ForeignKey(f"{name}_{'_'.join(c)}", c, ref, cols, enforced=True) for c, ref, cols in foreign)
    return TableSpec(name, read(spark, sf_dir, name) if df is None else df, key, keys, key_enforced=bool(key))


@lru_cache(maxsize=256)
def _model(application: str, sf_dir: str, name: str) -> Model:
    return infer_model(spec(SparkSession.getActiveSession(), sf_dir, name))


def model(spark: SparkSession, sf_dir: str, name: str) -> Model:
    """The inferred model of a test table; metadata, kept for the session."""
    return _model(spark.sparkContext.applicationId, sf_dir, name)


def graph(spark: SparkSession, sf_dir: str, names=SALES) -> PropertyGraph:
    return build_graph([(spec(spark, sf_dir, n), model(spark, sf_dir, n)) for n in names])


def order_part_spec(spark: SparkSession, sf_dir: str) -> TableSpec:
    """A link table of orders and parts: line items summed per pair."""
    lines = read(spark, sf_dir, "lineitem")
    linked = lines.groupBy("l_orderkey", "l_partkey").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"),
        F.count(F.lit(1)).alias("line_count"),
    )
    keys = (
        ForeignKey("order", ("l_orderkey",), "orders", ("o_orderkey",), enforced=True),
        ForeignKey("part", ("l_partkey",), "part", ("p_partkey",), enforced=True),
    )
    return TableSpec("order_part", linked, ("l_orderkey", "l_partkey"), keys, key_enforced=True)


def order_part_graph(spark: SparkSession, sf_dir: str, entities: bool = False) -> PropertyGraph:
    link = order_part_spec(spark, sf_dir)
    loads = [(link, infer_model(link))]
    if entities:
        loads += [(spec(spark, sf_dir, n), model(spark, sf_dir, n)) for n in ("orders", "part")]
    return build_graph(loads)


def shared_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Orders and events with keys of one name and hubs of one edge type, as tables without column prefixes have."""
    orders = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderpriority AS kind", "o_orderstatus AS state")
    events = read(spark, sf_dir, "events").selectExpr("event_id AS id", "event_type AS kind")
    specs = [TableSpec(n, df, ("id",), key_enforced=True) for n, df in (("orders", orders), ("events", events))]
    return build_graph([(s, infer_model(s)) for s in specs])


def status_part_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Line statuses and the parts they occur with: two or three sources that each have nearly all parts."""
    linked = read(spark, sf_dir, "lineitem").select("l_linestatus", "l_partkey").distinct()
    keys = (
        ForeignKey("status", ("l_linestatus",), "statuses", ("status",), enforced=True),
        ForeignKey("part", ("l_partkey",), "part", ("p_partkey",), enforced=True),
    )
    link = TableSpec("status_part", linked, ("l_linestatus", "l_partkey"), keys, key_enforced=True)
    return build_graph([(link, infer_model(link))])


def quantity_part_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Line quantities and the parts they occur with: each part has its own set of some twenty of fifty sources."""
    linked = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("quantity"), "l_partkey").distinct()
    keys = (
        ForeignKey("amount", ("quantity",), "amounts", ("quantity",), enforced=True),
        ForeignKey("part", ("l_partkey",), "part", ("p_partkey",), enforced=True),
    )
    link = TableSpec("quantity_part", linked, ("quantity", "l_partkey"), keys, key_enforced=True)
    return build_graph([(link, infer_model(link))])


def open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer is unknown for the lowest priority: a nullable foreign key."""
    orders = read(spark, sf_dir, "orders")
    return orders.withColumn("o_custkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")))


def staff_spec(spark: SparkSession, sf_dir: str) -> TableSpec:
    """Customers as a hierarchy: everyone but number 0 reports to the number without its last digit."""
    people = read(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.expr("CASE WHEN c_custkey > 0 THEN c_custkey div 10 END").alias("manager_id")
    )
    key = ForeignKey("manager", ("manager_id",), "staff", ("c_custkey",), enforced=True)
    return TableSpec("staff", people, ("c_custkey",), (key,), key_enforced=True)


def staff_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    staff = staff_spec(spark, sf_dir)
    return build_graph([(staff, infer_model(staff))])


def collision_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Parts beside hubs of their type under the same label."""
    renamed = model(spark, sf_dir, "part").rename(to_labels={"PType": "Part"})
    return build_graph([(spec(spark, sf_dir, "part"), renamed)])


def holed_orders(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """A graph that lacks the orders of status P."""
    orders = read(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P")
    return build_graph([(spec(spark, sf_dir, "orders", orders), model(spark, sf_dir, "orders"))])


def without_keys(table: TableSpec) -> TableSpec:
    """The same rows with no declared key, as a table without a primary key comes."""
    return replace(table, primary_key=(), key_enforced=False)
