"""Queries on what is kept and brought up to date: the bucketed store, streams, digest trees, closures, numbered edges, profiles and counts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from hubwright.operators import adjacency, changes, digest, distances, health, match, reach, snapshot, verify_tree
from hubwright.operators.build import build_graph, load_summary
from hubwright.operators.graph import DST, ID, SRC, PropertyGraph
from hubwright.plans import model as models, sketch
from hubwright.plans.starter import starter_frames
from hubwright.session import stage_table, staged_path
from hubwright.sources import buckets
from hubwright.sources.state import read_state
from hubwright.sources.tables import describe_columns
from hubwright.streaming import sync
from workloads import tables as t
from workloads.build_queries import _IS_HUB, _MARK, _PROFILED, _SUMMARY
from workloads.graph_queries import STAFF_EDGES
from workloads.registry import SALES, TWINS, query

# --- the store that merges on read -----------------------------------------------------------

_CHANGED = """SELECT 'o_orderkey=' || o_orderkey AS src_id,
    'value=' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS dst_id,
    CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END AS o_orderdate FROM orders"""


def _changed_orders(spark: SparkSession, sf: str) -> DataFrame:
    urgent = t.read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return (
        urgent.withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.col("o_totalprice") * 2).withColumn("o_orderdate", F.lit(None).cast("timestamp_ntz"))
    )


def _stored(spark: SparkSession, sf: str) -> str:
    """A store of all orders after an upsert of the urgent ones."""
    path, model = staged_path(spark), t.model(spark, sf, "orders")
    buckets.create(t.graph(spark, sf, ("orders",)), path, [model], bucket_rows=2000)
    buckets.upsert(spark, path, t.spec(spark, sf, "orders", _changed_orders(spark, sf)), model)
    return path


def _orders_with_status(graph: PropertyGraph) -> DataFrame:
    orders = graph.node("Order").select(F.col(ID).alias(SRC), "o_totalprice", "o_orderdate")
    return graph.edge("HAS_O_ORDERSTATUS").join(orders, SRC).select(SRC, DST, "o_totalprice", "o_orderdate")


@query("store_upsert", _CHANGED)
def _(spark, sf):
    return _orders_with_status(buckets.load(spark, _stored(spark, sf)))


@query("store_compacted", _CHANGED)
def _(spark, sf):
    path = _stored(spark, sf)
    buckets.compact(spark, path, share=0)
    return _orders_with_status(buckets.load(spark, path))


@query("store_first_version", SALES + _SUMMARY.replace("FROM nodes", "FROM nodes WHERE label LIKE 'O%' OR label = 'Customer' AND _id IN (SELECT 'c_custkey=' || o_custkey FROM orders)").replace("FROM edges", "FROM edges WHERE from_label = 'Order'"))
def _(spark, sf):
    return load_summary(buckets.load(spark, _stored(spark, sf), 1))


# --- sync as a stream --------------------------------------------------------------------------

@query("sync_stream", "SELECT 'event_id=' || event_id AS src_id, 'c_custkey=' || user_id AS dst_id, value, event_type FROM events")
def _(spark, sf):
    """All events, arriving as files in three rounds; each round is read as a stream, with some rows of the round before once more."""
    events, model = t.read(spark, sf, "events"), t.model(spark, sf, "events")
    source, path, checkpoint = (staged_path(spark) for _ in range(3))
    third = F.pmod("event_id", F.lit(3))
    for i in range(3):
        again = third == i - 1
        events.where((third == i) | again & (F.col("event_type") == "click")).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        sync.sync_stream(stream, path, t.spec(spark, sf, "events"), model, checkpoint, column="ts").awaitTermination()
    graph = buckets.load(spark, path)
    rows = graph.node("Event").select(F.col(ID).alias(SRC), "value")
    kinds = graph.edge("HAS_EVENT_TYPE").select(SRC, F.substring_index(DST, "=", -1).alias("event_type"))
    return graph.edge("HAS_USER").join(rows, SRC).join(kinds, SRC).select(SRC, DST, "value", "event_type")


@query("stream_mark", "SELECT replace(strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') AS high_water FROM events")
def _(spark, sf):
    events = t.read(spark, sf, "events")
    path = staged_path(spark)
    merge = sync.merge_batch(path, t.spec(spark, sf, "events"), t.model(spark, sf, "events"), "ts")
    half = events.agg(F.expr("percentile(event_id, 0.5)").alias("h")).first()["h"]
    for number, batch in enumerate((events.where(F.col("event_id") <= half), events.where(F.col("event_id") > half))):
        merge(batch, number)
        merge(batch, number)  # repeated, as after a failure: not written again
    return spark.createDataFrame([(buckets.stored_mark(spark, path),)], "high_water string")


@query("sync_state", TWINS["sync_incremental"])
def _(spark, sf):
    """The mark of an earlier run leads to an incremental one."""
    spec, model, path = t.spec(spark, sf, "orders"), t.model(spark, sf, "orders"), staged_path(spark)
    early = replace(spec, df=spec.df.where(F.col("o_orderdate") <= F.lit(_MARK).cast("timestamp_ntz")))
    first = sync.plan_sync(t.holed_orders(spark, sf), early, model, path, "o_orderdate")
    sync.commit_mark(spec, path, "o_orderdate", replace(first, high_water=_MARK))
    assert read_state(spark, path).first()["high_water"] == _MARK
    return sync.plan_sync(t.holed_orders(spark, sf), spec, model, path, "o_orderdate").graph.edge("HAS_O_ORDERPRIORITY")


# --- verification by a tree of digests ---------------------------------------------------------

@query(
    "verify_tree",
    """SELECT 'o_orderkey=' || o_orderkey AS _id, 'missing' AS side FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT'
       UNION ALL SELECT 'o_orderkey=' || o_orderkey, 'surplus' FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT'""",
)
def _(spark, sf):
    source = t.read(spark, sf, "orders").where("o_orderpriority <> '1-URGENT'")
    return verify_tree.compare(source, t.holed_orders(spark, sf), t.model(spark, sf, "orders")).differences


@query(
    "verify_tree_links",
    """SELECT 'o_orderkey=' || l_orderkey AS src_id, 'p_partkey=' || l_partkey AS dst_id, 'missing' AS side
       FROM lineitem GROUP BY ALL, l_orderkey, l_partkey HAVING count(*) > 1""".replace("GROUP BY ALL, ", "GROUP BY "),
)
def _(spark, sf):
    """Pairs that several lines have are left out of the graph and found missing; line items repeat keys."""
    link = t.order_part_spec(spark, sf)
    graph = build_graph([(replace(link, df=link.df.where("line_count = 1")), models.infer_model(link))])
    return verify_tree.compare(t.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), graph, models.infer_model(link)).differences


@query("verify_tree_levels", "SELECT 1 AS levels, CAST(0 AS BIGINT) AS differing, count(*) AS source_rows FROM orders")
def _(spark, sf):
    """Equal sides are settled by the first level: one aggregate."""
    orders = t.read(spark, sf, "orders")
    levels = verify_tree.compare(orders, t.graph(spark, sf, ("orders",)), t.model(spark, sf, "orders")).levels
    return orders.agg(F.lit(len(levels)).alias("levels"), F.lit(levels[-1][2]).cast("bigint").alias("differing"), F.count(F.lit(1)).alias("source_rows"))


# --- closures and numbered edges -----------------------------------------------------------------

@query(
    "reachable",
    f"""WITH RECURSIVE e AS ({STAFF_EDGES}), p(start_id, end_id, hops) AS (
          SELECT src_id, dst_id, 1 FROM e UNION ALL SELECT start_id, e.dst_id, hops + 1 FROM p JOIN e ON e.src_id = p.end_id)
        SELECT start_id, end_id, hops FROM p""",
)
def _(spark, sf):
    return reach.reachable(t.staff_graph(spark, sf), "HAS_MANAGER")


@query(
    "closure_from",
    f"""WITH RECURSIVE e AS ({STAFF_EDGES}), p(start_id, end_id, hops) AS (
          SELECT 'c_custkey=' || c_custkey, 'c_custkey=' || c_custkey, 0 FROM customer WHERE c_mktsegment = 'BUILDING'
          UNION ALL SELECT start_id, e.src_id, hops + 1 FROM p JOIN e ON e.dst_id = p.end_id)
        SELECT start_id, end_id, hops FROM p""",
)
def _(spark, sf):
    """Everyone below the people of one segment."""
    chosen = t.read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c_custkey="), F.col("c_custkey").cast("string")).alias(ID))
    return reach.closure_from(t.staff_graph(spark, sf), chosen, "HAS_MANAGER", "in")


_TWO_HOPS = "SELECT DISTINCT 'c_custkey=' || o_custkey AS start_id, 'value=' || o_orderpriority AS end_id FROM orders"


@query("two_hop_numbers", _TWO_HOPS)
def _(spark, sf):
    graph = t.graph(spark, sf)
    placed, priority = ("Order", "HAS_O_CUSTKEY", "Customer"), ("Order", "HAS_O_ORDERPRIORITY", "OOrderpriority")
    made = adjacency.build_adjacency(graph, [placed, priority], bucket_edges=5000)
    return adjacency.two_hops(made, graph.node("Customer"), (placed, adjacency.IN), (priority, adjacency.OUT))


@query("two_hop_pairs", _TWO_HOPS)
def _(spark, sf):
    return match.two_hop_pairs(t.graph(spark, sf), "HAS_O_CUSTKEY", "HAS_O_ORDERPRIORITY")


# --- kept profiles and counts ----------------------------------------------------------------------

_KEPT_TABLES = ("orders", "events", "documents", "conversations", "part")
_KEPT_SQL = " UNION ALL ".join(
    f"SELECT '{table}' AS source_table, '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, count(*) AS row_count FROM {table}"
    for table in _KEPT_TABLES for c in _PROFILED[table]
)


def _kept_profiles(spark: SparkSession, sf: str, of) -> DataFrame:
    """Each table's state saved from two halves of its rows, as a load and a delta."""
    whole = None
    for name in _KEPT_TABLES:
        df, path = t.read(spark, sf, name), staged_path(spark)
        half = F.pmod(F.xxhash64(*df.columns), F.lit(2))
        for i in (0, 1):
            sketch.save_state(sketch.profile_state(df.where(half == i)), path)
        frame = of(sketch.load_state(spark, path)).select(F.lit(name).alias("source_table"), "*").withColumnRenamed("column", "column_name")
        whole = frame if whole is None else whole.unionByName(frame)
    return whole


@query("profile_after_delta", f"SELECT * FROM ({_KEPT_SQL}) WHERE distinct_values <= 1000")
def _(spark, sf):
    return _kept_profiles(spark, sf, lambda state: sketch.distinct_of(state).where("exact").drop("exact"))


@query("dimension_columns_after_delta", f"SELECT * FROM ({_KEPT_SQL}) WHERE {_IS_HUB}")
def _(spark, sf):
    return _kept_profiles(spark, sf, sketch.dimension_columns_of)


_MOVED = SALES.replace(
    "'value=' || o_orderstatus FROM orders\n  UNION ALL SELECT 'Order'",
    "'value=' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END FROM orders\n  UNION ALL SELECT 'Order'",
).replace(
    "SELECT DISTINCT 'OOrderstatus', 'value=' || o_orderstatus FROM orders",
    "SELECT DISTINCT 'OOrderstatus', 'value=' || o_orderstatus FROM orders UNION ALL SELECT DISTINCT 'OOrderstatus', 'value=X' FROM orders WHERE o_orderpriority = '1-URGENT'",
)


def _moved(spark: SparkSession, sf: str) -> tuple[PropertyGraph, changes.Changes]:
    graph = t.graph(spark, sf)
    return graph, changes.load_changes(graph, t.spec(spark, sf, "orders", _changed_orders(spark, sf)), t.model(spark, sf, "orders"))


@query("degrees_after_delta", _MOVED + "SELECT label, _id, degree FROM degrees")
def _(spark, sf):
    graph, found = _moved(spark, sf)
    return changes.apply_to_degrees(stage_table(health.degrees(graph)), found)


@query("patterns_after_delta", _MOVED + 'SELECT from_label AS "from", type, to_label AS "to", count(*) AS count FROM edges GROUP BY ALL')
def _(spark, sf):
    graph, found = _moved(spark, sf)
    return changes.apply_to_patterns(stage_table(digest.pattern_counts(graph)), found)


@query("label_counts_after_delta", _MOVED + "SELECT label, count(*) AS count FROM nodes GROUP BY label")
def _(spark, sf):
    graph, found = _moved(spark, sf)
    return changes.apply_to_label_counts(stage_table(digest.label_counts(graph)), found)


# --- models, columns, starters and snapshots at rest ------------------------------------------------

@query("model_file", SALES + _SUMMARY)
def _(spark, sf):
    """The sales graph, built from models that were written and read back."""
    loads = []
    for name in t.SALES:
        path = staged_path(spark)
        models.write_model(spark, t.model(spark, sf, name), path)
        loads.append((t.spec(spark, sf, name), models.read_model(spark, path)))
    return load_summary(build_graph(loads))


_TYPES = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END"


@query(
    "describe_columns",
    " UNION ALL ".join(
        f"""SELECT '{table}' AS source_table, CAST(column_index AS INTEGER) AS position, column_name AS name, {_TYPES} AS type, (SELECT count(*) FROM {table}) AS row_count
            FROM duckdb_columns() WHERE table_name = '{table}'"""
        for table in ("orders", "customer", "events")
    ),
)
def _(spark, sf):
    whole = None
    for name in ("orders", "customer", "events"):
        df = t.read(spark, sf, name)
        cells = [F.struct(*[F.lit(r[c]).alias(c) for c in ("position", "name", "type")]) for r in describe_columns(df).collect()]
        frame = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("source_table"), "row_count", F.inline(F.array(*cells)))
        whole = frame if whole is None else whole.unionByName(frame)
    return whole


@query(
    "starter_results",
    """SELECT 'rows_per_value' AS analysis, o_orderstatus AS item, count(*) AS amount FROM orders GROUP BY o_orderstatus
       UNION ALL SELECT * FROM (SELECT 'sharing', 'c_custkey=' || o_custkey AS item, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS amount
         FROM orders GROUP BY o_custkey HAVING count(*) > 1 ORDER BY amount DESC, item LIMIT 10)
       UNION ALL SELECT * FROM (SELECT 'busiest', 'c_custkey=' || o_custkey AS item, count(*) AS amount FROM orders GROUP BY o_custkey ORDER BY amount DESC, item LIMIT 10)""",
)
def _(spark, sf):
    """The first analyses that fit the orders, as one table."""
    frames = starter_frames(t.graph(spark, sf), t.model(spark, sf, "orders"))
    whole = None
    for name in ("rows_per_value", "sharing", "busiest"):
        frame = frames[name]()
        item, amount = frame.columns
        frame = frame.select(F.lit(name).alias("analysis"), F.col(item).alias("item"), F.col(amount).cast("bigint").alias("amount"))
        whole = frame if whole is None else whole.unionByName(frame)
    return whole


@query("snapshot_files", TWINS["snapshot_edges"])
def _(spark, sf):
    """The links of a snapshot, read back from the files that the sink writes."""
    path = staged_path(spark)
    snapshot.snapshot_sink(snapshot.snapshot(t.graph(spark, sf)), path)
    return spark.read.json(f"{path}/links").select("from_label", SRC, "type", "to_label", DST)


# the fewest hops between two people of a tree go over the common superior that is nearest to both
@query(
    "distances",
    f"""WITH RECURSIVE e AS ({STAFF_EDGES}), up(start_id, end_id, hops) AS (
          SELECT 'c_custkey=' || c_custkey, 'c_custkey=' || c_custkey, 0 FROM customer
          UNION ALL SELECT start_id, e.dst_id, hops + 1 FROM up JOIN e ON e.src_id = up.end_id),
        pairs AS (SELECT DISTINCT 'c_custkey=' || o_custkey AS a, 'c_custkey=' || (o_orderkey % (SELECT count(*) FROM customer)) AS b FROM orders)
        SELECT a AS source_id, b AS target_id, min(x.hops + y.hops) AS hops
        FROM pairs JOIN up x ON x.start_id = a JOIN up y ON y.start_id = b AND y.end_id = x.end_id GROUP BY a, b""",
)
def _(spark, sf):
    """Each order's customer and another one: how far apart they are in the hierarchy."""
    people = t.read(spark, sf, "customer").count()
    name = lambda c: F.concat(F.lit("c_custkey="), c.cast("string"))
    orders = t.read(spark, sf, "orders").select(name(F.col("o_custkey")).alias("a"), name(F.pmod("o_orderkey", F.lit(people))).alias("b"))
    asked = orders.select(distances.node("Staff", "a").alias("source"), distances.node("Staff", "b").alias("target"))
    found = distances.distances(t.staff_graph(spark, sf), asked)
    return found.select(F.col("source.id").alias("source_id"), F.col("target.id").alias("target_id"), "hops")
