"""Sources, scalar functions, profiling, models, graph building, sync and verification."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from hubwright.functions.text import indel_ratio, normalize_text, token_sort
from hubwright.functions.values import to_graph_value
from hubwright.operators import build, upsert, verify
from hubwright.plans.model import MODEL_ROW_SCHEMA, infer_model, model_rows
from hubwright.plans.profile import dimension_columns, profile_columns
from hubwright.session import checkpoint_dir, stage_table
from hubwright.sources.store import load_saved_graph, save_graph
from hubwright.sources.tables import ForeignKey, TableSpec, check_foreign_key, check_primary_key, scan_table
from hubwright.streaming import sync
from workloads import tables as t
from workloads.registry import SALES, query


@query("scan_project", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, sf):
    return scan_table(t.read(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query(
    "pk_violations",
    """SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem
       GROUP BY ALL HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""",
)
def _(spark, sf):
    return check_primary_key(TableSpec("lineitem", t.read(spark, sf, "lineitem"), ("l_orderkey", "l_linenumber")))


@query(
    "fk_violations",
    """SELECT o_custkey, count(*) AS row_count FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY o_custkey""",
)
def _(spark, sf):
    orders = t.spec(spark, sf, "orders")
    solvent = t.spec(spark, sf, "customer", t.read(spark, sf, "customer").where("c_acctbal >= 0"))
    return check_foreign_key(orders, orders.foreign_keys[0], solvent)


@query(
    "value_coercion",
    """SELECT event_id, replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') AS ts_text,
              strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day_text,
              CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS amount,
              lower(hex(encode(event_type))) AS type_hex,
              '["' || event_type || '"]' AS nested
       FROM events""",
)
def _(spark, sf):
    typed = t.read(spark, sf, "events").select(
        "event_id",
        F.col("ts").alias("ts_text"),
        F.col("ts").cast("date").alias("day_text"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
        F.col("event_type").cast("binary").alias("type_hex"),
        F.array("event_type").alias("nested"),
    )
    return typed.select(*[to_graph_value(F.col(f.name), f.dataType).alias(f.name) for f in typed.schema.fields])


def _framed(*columns: str) -> str:
    parts = [f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns]
    return "sha1(" + " || ',' || ".join(parts) + ")"


_LINE_SHA = _framed(
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S')",
)


@query("synthetic_key", f"SELECT DISTINCT {_LINE_SHA} AS _row_key, l_orderkey, l_partkey, l_shipdate FROM lineitem")
def _(spark, sf):
    nodes = build.build_nodes(t.read(spark, sf, "lineitem"), t.model(spark, sf, "lineitem").drop("HAS_L_ORDERKEY").drop("HAS_L_PARTKEY"))
    return nodes.select("_row_key", "l_orderkey", "l_partkey", "l_shipdate")


@query(
    "normalize_text",
    "SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS norm FROM documents",
)
def _(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", normalize_text(F.col("text")).alias("norm"))


def tokens_sorted(column: str) -> str:
    return rf"array_to_string(list_sort(list_filter(regexp_split_to_array({column}, '[\s\p{{Z}}]+'), lambda x: x <> '')), ' ')"


def common_length(a: str, b: str) -> str:
    """Longest common subsequence of two SQL strings, row by row."""
    # both loops run over positions, wrapped in lists so that every step maps a list to a list
    cell = f"CASE WHEN {b}[j[1]] = {a}[i[1]] THEN acc[j[1]] + 1 ELSE greatest(r[j[1]], acc[j[1] + 1]) END"
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda y: [y]), lambda r, j: list_append(r, {cell}), [CAST(0 AS BIGINT)])"
    start = f"list_transform(range(0, length({b}) + 1), lambda z: CAST(0 AS BIGINT))"
    return f"list_last(list_reduce(list_transform(range(1, length({a}) + 1), lambda x: [x]), lambda acc, i: {row}, {start}))"


def ratio(a: str, b: str) -> str:
    return f"2.0::DOUBLE * {common_length(a, b)} / (length({a}) + length({b}))"


@query("token_sort", f"SELECT doc_id, {tokens_sorted('text')} AS sorted_text FROM documents")
def _(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", token_sort(F.col("text")).alias("sorted_text"))


@query(
    "indel_ratio",
    f"""WITH names AS (SELECT p_partkey, {tokens_sorted('p_name')} AS a, {tokens_sorted('lower(p_type)')} AS b FROM part)
        SELECT p_partkey, {ratio('a', 'b')} AS score FROM names""",
)
def _(spark, sf):
    names = t.read(spark, sf, "part").select(
        "p_partkey", token_sort(F.col("p_name")).alias("a"), token_sort(F.lower("p_type")).alias("b")
    )
    return names.select("p_partkey", indel_ratio("a", "b").alias("score"))


_PROFILED = {
    "orders": ("o_orderstatus", "o_orderpriority"),
    "customer": ("c_name", "c_mktsegment"),
    "part": ("p_name", "p_brand", "p_type"),
    "documents": ("text", "lang", "source"),
    "events": ("event_type", "props"),
    "conversations": ("role", "text"),
    "nation": ("n_name",),
    "region": ("r_name",),
    "lineitem": ("l_returnflag", "l_linestatus"),
}
_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{table}' AS source_table, '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, count(*) AS row_count FROM {table}"
    for table, columns in _PROFILED.items()
    for c in columns
)
_IS_HUB = """distinct_values > 1 AND distinct_values < row_count
  AND distinct_values <= least(50, greatest(20, CAST(floor(row_count * 0.1) AS BIGINT)))"""


def _per_table(spark, sf, run):
    frames = [run(t.read(spark, sf, name)).select(F.lit(name).alias("source_table"), "*") for name in _PROFILED]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole.withColumnRenamed("column", "column_name")


@query("profile_columns", _PROFILE_SQL)
def _(spark, sf):
    return _per_table(spark, sf, profile_columns)


@query("dimension_columns", f"SELECT * FROM ({_PROFILE_SQL}) WHERE {_IS_HUB}")
def _(spark, sf):
    return _per_table(spark, sf, dimension_columns)


def _model_sql(table: str, label: str, key: str, hubs: dict[str, str], parents: list[tuple[str, str, str]]) -> str:
    lines = [
        f"SELECT '{table}' AS source_table, 'node' AS mode, '{label}' AS label, '{key}' AS key, 'foreign_key' AS kind, "
        f"'{rel}' AS rel_type, '{to}' AS to_label, '{via}' AS via, false AS self_reference, CAST(NULL AS BIGINT) AS distinct_values"
        for rel, to, via in parents
    ]
    for column, to in hubs.items():
        lines.append(
            f"SELECT '{table}', 'node', '{label}', '{key}', 'dimension', 'HAS_' || upper('{column}'), '{to}', '{column}', false, distinct_values "
            f"FROM (SELECT count(DISTINCT {column}) AS distinct_values, count(*) AS row_count FROM {table}) WHERE {_IS_HUB}"
        )
    return " UNION ALL ".join(lines)


@query(
    "model_summary",
    " UNION ALL ".join([
        _model_sql("orders", "Order", "o_orderkey", {"o_orderstatus": "OOrderstatus", "o_orderpriority": "OOrderpriority"},
                   [("HAS_O_CUSTKEY", "Customer", "o_custkey")]),
        _model_sql("lineitem", "Lineitem", "_row_key", {"l_returnflag": "LReturnflag", "l_linestatus": "LLinestatus"},
                   [("HAS_L_ORDERKEY", "Order", "l_orderkey"), ("HAS_L_PARTKEY", "Part", "l_partkey"), ("HAS_L_SUPPKEY", "Supplier", "l_suppkey")]),
        _model_sql("customer", "Customer", "c_custkey", {"c_mktsegment": "CMktsegment", "c_name": "CName"},
                   [("HAS_C_NATIONKEY", "Nation", "c_nationkey")]),
        _model_sql("events", "Event", "event_id", {"event_type": "EventType", "props": "Prop"}, [("HAS_USER", "Customer", "user_id")]),
        _model_sql("labels", "Label", "doc_id", {}, [("HAS_DOC", "Document", "doc_id")]),
        "SELECT 'order_part', 'join', 'Order', 'l_orderkey', 'join', 'ORDER_PART', 'Part', 'l_partkey', false, NULL",
    ]),
)
def _(spark, sf):
    names = ("orders", "lineitem", "customer", "events", "labels")
    models = [t.model(spark, sf, n) for n in names] + [infer_model(t.order_part_spec(spark, sf))]
    return spark.createDataFrame([row for m in models for row in model_rows(m)], MODEL_ROW_SCHEMA)


@query("build_nodes", "SELECT 'o_orderkey=' || o_orderkey AS _id, 'o_orderkey' AS _key, o_orderkey, o_totalprice, o_orderdate FROM orders")
def _(spark, sf):
    return build.build_nodes(t.read(spark, sf, "orders"), t.model(spark, sf, "orders"))


def _relationship(model, rel_type):
    return next(r for r in model.relationships if r.rel_type == rel_type)


@query(
    "build_dimension_nodes",
    "SELECT DISTINCT 'value=' || o_orderpriority AS _id, 'value' AS _key, o_orderpriority AS value FROM orders",
)
def _(spark, sf):
    rel = _relationship(t.model(spark, sf, "orders"), "HAS_O_ORDERPRIORITY")
    return build.build_dimension_nodes(t.read(spark, sf, "orders"), rel)


@query(
    "build_fk_edges",
    """SELECT 'o_orderkey=' || o_orderkey AS src_id, 'c_custkey=' || o_custkey AS dst_id
       FROM orders WHERE o_orderpriority <> '5-LOW'""",
)
def _(spark, sf):
    model = t.model(spark, sf, "orders")
    return build.build_edges(t.open_orders(spark, sf), model, _relationship(model, "HAS_O_CUSTKEY"))


@query("build_dimension_edges", "SELECT 'o_orderkey=' || o_orderkey AS src_id, 'value=' || o_orderstatus AS dst_id FROM orders")
def _(spark, sf):
    model = t.model(spark, sf, "orders")
    return build.build_edges(t.read(spark, sf, "orders"), model, _relationship(model, "HAS_O_ORDERSTATUS"))


@query(
    "build_stub_nodes",
    "SELECT DISTINCT 'c_custkey=' || o_custkey AS _id, 'c_custkey' AS _key, o_custkey AS c_custkey FROM orders WHERE o_orderpriority <> '5-LOW'",
)
def _(spark, sf):
    return build.build_stub_nodes(t.open_orders(spark, sf), ("c_custkey",), ("o_custkey",))


@query(
    "build_composite_edges",
    """SELECT DISTINCT to_json({'conv_id': c.conv_id, 'turn': c.turn})::VARCHAR AS src_id,
              to_json({'conv_id': c.conv_id, 'turn': c.turn - 1})::VARCHAR AS dst_id
       FROM conversations c WHERE c.turn > 0""",
)
def _(spark, sf):
    turns = t.read(spark, sf, "conversations").withColumn("previous", F.expr("CASE WHEN turn > 0 THEN turn - 1 END"))
    key = ForeignKey("previous_turn", ("conv_id", "previous"), "conversations", ("conv_id", "turn"))
    model = infer_model(TableSpec("conversations", turns, ("conv_id", "turn"), (key,)))
    return build.build_edges(turns, model, model.relationships[0])


@query(
    "build_join_edges",
    """SELECT 'o_orderkey=' || l_orderkey AS src_id, 'p_partkey=' || l_partkey AS dst_id,
              CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, count(*) AS line_count
       FROM lineitem GROUP BY l_orderkey, l_partkey""",
)
def _(spark, sf):
    link = t.order_part_spec(spark, sf)
    return build.build_join_edges(link.df, infer_model(link), unique=True)


def _urgent(spark, sf):
    return t.read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")


@query(
    "upsert_nodes",
    """SELECT 'o_orderkey=' || o_orderkey AS _id, o_orderkey,
              CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
              CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS o_orderdate
       FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority = '1-URGENT'""",
)
def _(spark, sf):
    model = t.model(spark, sf, "orders")
    changed = _urgent(spark, sf).withColumn("o_totalprice", F.col("o_totalprice") * 2).withColumn("o_orderdate", F.lit(None).cast("timestamp_ntz"))
    old = t.holed_orders(spark, sf).node("Order")
    return upsert.upsert_nodes(old, build.build_nodes(changed, model)).drop("_key")


@query(
    "upsert_edges",
    """SELECT 'o_orderkey=' || o_orderkey AS src_id,
              'value=' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS dst_id FROM orders""",
)
def _(spark, sf):
    model = t.model(spark, sf, "orders")
    changed = t.spec(spark, sf, "orders", _urgent(spark, sf).withColumn("o_orderstatus", F.lit("X")))
    merged = sync.merge_load(t.graph(spark, sf, ("orders",)), changed, model)
    return merged.edge("HAS_O_ORDERSTATUS")


@query(
    "upsert_edges_keep_old",
    """SELECT 'o_orderkey=' || o_orderkey AS src_id, 'value=' || o_orderstatus AS dst_id FROM orders
       UNION SELECT 'o_orderkey=' || o_orderkey, 'value=X' FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def _(spark, sf):
    model = t.model(spark, sf, "orders")
    changed = t.spec(spark, sf, "orders", _urgent(spark, sf).withColumn("o_orderstatus", F.lit("X")))
    merged = sync.merge_load(t.graph(spark, sf, ("orders",)), changed, model, replace_for_upserted=False)
    return merged.edge("HAS_O_ORDERSTATUS")


@query(
    "skipped_null_endpoints",
    "SELECT count(*) AS row_count, count(*) FILTER (o_orderpriority = '5-LOW') AS skipped FROM orders",
)
def _(spark, sf):
    keys = (
        ForeignKey("order", ("o_orderkey",), "orders", ("o_orderkey",)),
        ForeignKey("customer", ("o_custkey",), "customer", ("c_custkey",)),
    )
    link = TableSpec("placed_by", t.open_orders(spark, sf), ("o_orderkey", "o_custkey"), keys)
    return build.skipped_null_endpoints(link.df, infer_model(link))


@query(
    "wipe_label",
    SALES + """SELECT 'node' AS kind, label AS name, count(*) AS count FROM nodes WHERE label <> 'Customer' GROUP BY label
    UNION ALL SELECT 'edge', type, count(*) FROM edges WHERE 'Customer' NOT IN (from_label, to_label) GROUP BY type""",
)
def _(spark, sf):
    return build.load_summary(build.wipe_label(t.graph(spark, sf), "Customer"))


_SUMMARY = """SELECT 'node' AS kind, label AS name, count(*) AS count FROM nodes GROUP BY label
    UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type"""


@query("load_summary", SALES + _SUMMARY)
def _(spark, sf):
    return build.load_summary(t.graph(spark, sf))


@query("graph_roundtrip", SALES + _SUMMARY)
def _(spark, sf):
    path = f"{checkpoint_dir(spark)}/graph-{uuid.uuid4().hex}"
    save_graph(t.graph(spark, sf), path)
    return build.load_summary(load_saved_graph(spark, path))


@query(
    "build_graph_counts",
    """SELECT 'node' AS kind, 'Order' AS name, count(*) AS count FROM orders
       UNION ALL SELECT 'node', 'Part', count(*) FROM part
       UNION ALL SELECT 'node', 'Customer', count(DISTINCT o_custkey) FROM orders
       UNION ALL SELECT 'node', 'Supplier', count(DISTINCT l_suppkey) FROM lineitem
       UNION ALL SELECT 'node', 'Lineitem', count(*) FROM (SELECT DISTINCT * FROM lineitem)
       UNION ALL SELECT 'node', 'LReturnflag', count(DISTINCT l_returnflag) FROM lineitem
       UNION ALL SELECT 'node', 'LLinestatus', count(DISTINCT l_linestatus) FROM lineitem
       UNION ALL SELECT 'node', 'OOrderstatus', count(DISTINCT o_orderstatus) FROM orders
       UNION ALL SELECT 'node', 'OOrderpriority', count(DISTINCT o_orderpriority) FROM orders
       UNION ALL SELECT 'edge', type, n FROM (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM lineitem)),
            (VALUES ('HAS_L_ORDERKEY'), ('HAS_L_PARTKEY'), ('HAS_L_SUPPKEY'), ('HAS_L_RETURNFLAG'), ('HAS_L_LINESTATUS')) AS v(type)
       UNION ALL SELECT 'edge', type, n FROM (SELECT count(*) AS n FROM orders),
            (VALUES ('HAS_O_CUSTKEY'), ('HAS_O_ORDERSTATUS'), ('HAS_O_ORDERPRIORITY')) AS v(type)
       UNION ALL SELECT 'edge', 'ORDER_PART', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)""",
)
def _(spark, sf):
    link = t.order_part_spec(spark, sf)
    part = t.spec(spark, sf, "part")
    loads = [(t.spec(spark, sf, n), t.model(spark, sf, n)) for n in ("lineitem", "orders")]
    plain_part = replace(t.model(spark, sf, "part"), relationships=())
    return build.load_summary(build.build_graph([*loads, (part, plain_part), (link, infer_model(link))], stage=stage_table))


# --- sync and verification -------------------------------------------------------------------

_MARK = "1998-01-01T00:00:00"


@query("sync_idempotent", SALES + _SUMMARY)
def _(spark, sf):
    graph = t.graph(spark, sf)
    for _ in range(2):
        graph = sync.sync_full(graph, t.spec(spark, sf, "orders"), t.model(spark, sf, "orders"))
    return build.load_summary(graph)


@query(
    "sync_delta",
    f"""SELECT count(*) FILTER (o_orderdate >= TIMESTAMP '{_MARK}') AS changed,
               count(*) FILTER (o_orderdate = TIMESTAMP '{_MARK}') AS at_mark,
               count(*) FILTER (o_orderdate IS NULL) AS without_mark FROM orders""",
)
def _(spark, sf):
    return sync.sync_delta(t.read(spark, sf, "orders"), "o_orderdate", _MARK)


@query(
    "sync_incremental",
    f"""SELECT 'o_orderkey=' || o_orderkey AS src_id, 'value=' || o_orderpriority AS dst_id FROM orders
        WHERE o_orderstatus <> 'P' OR o_orderdate >= TIMESTAMP '{_MARK}'""",
)
def _(spark, sf):
    graph = t.holed_orders(spark, sf)
    synced = sync.sync_incremental(graph, t.spec(spark, sf, "orders"), t.model(spark, sf, "orders"), "o_orderdate", _MARK)
    return synced.edge("HAS_O_ORDERPRIORITY")


@query("high_water", "SELECT strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS high_water FROM orders")
def _(spark, sf):
    return sync.high_water(t.read(spark, sf, "orders"), "o_orderdate")


@query(
    "verify_counts",
    """SELECT count(*) AS source_rows, count(*) AS source_keys, count(*) FILTER (o_orderstatus <> 'P') AS graph_count,
              CAST(0 AS BIGINT) AS repeated_rows, count(*) FILTER (o_orderstatus = 'P') = 0 AS match FROM orders""",
)
def _(spark, sf):
    return verify.verify_counts(t.read(spark, sf, "orders"), t.holed_orders(spark, sf), t.model(spark, sf, "orders"))


@query("verify_missing", "SELECT 'o_orderkey=' || o_orderkey AS _id FROM orders WHERE o_orderstatus = 'P'")
def _(spark, sf):
    return verify.verify_full(t.read(spark, sf, "orders"), t.holed_orders(spark, sf), t.model(spark, sf, "orders"))


@query("verify_surplus", "SELECT 'o_orderkey=' || o_orderkey AS _id FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(spark, sf):
    kept = t.read(spark, sf, "orders").where("o_orderpriority <> '1-URGENT'")
    return verify.verify_surplus(kept, t.graph(spark, sf), t.model(spark, sf, "orders"))


@query("verify_sample", "SELECT least(100, count(*)) AS checked, CAST(0 AS BIGINT) AS missing FROM orders")
def _(spark, sf):
    return verify.verify_sample(t.read(spark, sf, "orders"), t.graph(spark, sf), t.model(spark, sf, "orders"))


@query(
    "verify_verdict",
    """SELECT CAST(sum(n) AS BIGINT) AS source_rows, count(*) AS source_keys, count(*) AS graph_count,
              CAST(0 AS BIGINT) AS keyless_rows, CAST(0 AS BIGINT) AS missing, true AS ok
       FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey)""",
)
def _(spark, sf):
    link = t.order_part_spec(spark, sf)
    lines = replace(link, df=t.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey"))
    return verify.verify(lines.df, t.order_part_graph(spark, sf), infer_model(link))
