"""Pattern questions, digest, health report, duplicates and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from hubwright.functions.values import truncate_value
from hubwright.operators import dedupe, digest, health, match, paths, results, snapshot
from hubwright.operators.build import build_graph
from hubwright.operators.cooccurrence import co_occurrence
from hubwright.operators.graph import DST, ID, SRC, PropertyGraph
from hubwright.session import cut_lineage
from workloads import tables as t
from workloads.build_queries import ratio, tokens_sorted
from workloads.registry import SALES, query



# --- patterns --------------------------------------------------------------------------------

@query("match_label", "SELECT 'c_custkey=' || c_custkey AS _id, c_custkey, c_name, c_acctbal FROM customer")
def _(spark, sf):
    return match.match(t.graph(spark, sf), "Customer").drop("_key")


@query("where_dimension", "SELECT 'o_orderkey=' || o_orderkey AS _id, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    return match.where_dimension(t.graph(spark, sf), "Order", "HAS_O_ORDERSTATUS", ["F"]).select(ID, "o_totalprice")


@query(
    "in_list",
    "SELECT 'o_orderkey=' || o_orderkey AS _id FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice IS NOT NULL",
)
def _(spark, sf):
    chosen = match.where_dimension(t.graph(spark, sf), "Order", "HAS_O_ORDERSTATUS", ["F", "P"])
    return match.has_property(chosen, "o_totalprice").select(ID)


@query(
    "expand_out",
    """SELECT 'o_orderkey=' || o_orderkey AS order_id, 'c_custkey=' || c_custkey AS customer_id, c_name
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def _(spark, sf):
    graph = t.graph(spark, sf)
    orders = graph.node("Order").select(F.col(ID).alias("order_id"))
    step = match.expand(graph, orders, "HAS_O_CUSTKEY", "out", on="order_id", to="customer_id")
    return match.attach(graph, step, "Customer", "customer_id", ["c_name"]).select("order_id", "customer_id", "c_name")


@query(
    "expand_in",
    """SELECT 'n_nationkey=' || n_nationkey AS nation_id, n_name, 'c_custkey=' || c_custkey AS customer_id
       FROM nation JOIN customer ON c_nationkey = n_nationkey""",
)
def _(spark, sf):
    graph = t.graph(spark, sf)
    nations = graph.node("Nation").select(F.col(ID).alias("nation_id"), "n_name")
    return match.expand(graph, nations, "HAS_C_NATIONKEY", "in", on="nation_id", to="customer_id")


STAFF_EDGES = """SELECT 'c_custkey=' || c_custkey AS src_id, 'c_custkey=' || (c_custkey // 10) AS dst_id FROM customer WHERE c_custkey > 0"""


@query(
    "expand_both",
    f"""WITH e AS ({STAFF_EDGES}) SELECT src_id AS _id, dst_id AS other_id FROM e
        UNION ALL SELECT dst_id, src_id FROM e WHERE src_id <> dst_id""",
)
def _(spark, sf):
    graph = t.staff_graph(spark, sf)
    return match.expand(graph, graph.node("Staff").select(ID), "HAS_MANAGER", "both")


@query(
    "viz_paths",
    """SELECT src || ' ' || type || ' ' || dst AS path FROM (
         SELECT 'Order:o_orderkey=' || o_orderkey AS src, 'HAS_O_CUSTKEY' AS type, 'Customer:c_custkey=' || o_custkey AS dst, 'Customer' AS l, 'c_custkey=' || o_custkey AS d, 'o_orderkey=' || o_orderkey AS s FROM orders
         UNION ALL SELECT 'Order:o_orderkey=' || o_orderkey, 'HAS_O_ORDERSTATUS', 'OOrderstatus:value=' || o_orderstatus, 'OOrderstatus', 'value=' || o_orderstatus, 'o_orderkey=' || o_orderkey FROM orders
         UNION ALL SELECT 'Order:o_orderkey=' || o_orderkey, 'HAS_O_ORDERPRIORITY', 'OOrderpriority:value=' || o_orderpriority, 'OOrderpriority', 'value=' || o_orderpriority, 'o_orderkey=' || o_orderkey FROM orders
       ) ORDER BY s, l, d, type LIMIT 300""",
)
def _(spark, sf):
    first = match.paths_from(t.graph(spark, sf), "Order")
    return results.paths_as_result(first).select(F.array_join("path", " ").alias("path"))


@query("count_per_dimension", "SELECT o_orderstatus AS value, count(*) AS row_count FROM orders GROUP BY 1")
def _(spark, sf):
    return match.count_per_target(t.graph(spark, sf), "Order", "HAS_O_ORDERSTATUS", "OOrderstatus")


@query("count_distinct", "SELECT 'p_partkey=' || l_partkey AS dst_id, count(DISTINCT l_orderkey) AS neighbors FROM lineitem GROUP BY l_partkey")
def _(spark, sf):
    return match.count_distinct_neighbors(t.order_part_graph(spark, sf), "ORDER_PART")


@query(
    "two_hop_collect",
    """SELECT 'c_custkey=' || o_custkey AS start_id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS reached
       FROM orders GROUP BY o_custkey""",
)
def _(spark, sf):
    reached = match.collect_two_hops(t.graph(spark, sf), "HAS_O_CUSTKEY", "HAS_O_ORDERPRIORITY")
    return reached.select("start_id", F.array_join("reached", ",").alias("reached"))


@query(
    "aggregate_by_neighbor",
    """SELECT c_mktsegment AS segment, count(*) AS order_count, max(o_totalprice) AS largest,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
)
def _(spark, sf):
    graph = t.graph(spark, sf)
    orders = graph.node("Order").select(F.col(ID).alias("order_id"), "o_totalprice")
    to_customer = match.expand(graph, orders, "HAS_O_CUSTKEY", "out", on="order_id", to="customer_id")
    to_segment = match.expand(graph, to_customer, "HAS_C_MKTSEGMENT", "out", on="customer_id", to="segment_id")
    per_hub = match.aggregate(
        to_segment, ["segment_id"],
        order_count=F.count(F.lit(1)), largest=F.max("o_totalprice"),
        revenue=F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"),
    )
    named = match.attach(graph, per_hub, "CMktsegment", "segment_id", ["value"])
    return named.select(F.col("value").alias("segment"), "order_count", "largest", "revenue")


@query("having_filter", "SELECT 'c_custkey=' || o_custkey AS dst_id, count(*) AS orders FROM orders GROUP BY o_custkey HAVING count(*) > 10")
def _(spark, sf):
    counts = match.aggregate(t.graph(spark, sf).edge("HAS_O_CUSTKEY"), [DST], orders=F.count(F.lit(1)))
    return match.where_count(counts, "orders", 10)


@query("top_k", "SELECT 'o_orderkey=' || o_orderkey AS _id, o_totalprice FROM orders ORDER BY o_totalprice DESC, _id LIMIT 10")
def _(spark, sf):
    return match.top_k(t.graph(spark, sf).node("Order").select(ID, "o_totalprice"), 10, "o_totalprice", [ID])


@query(
    "shared_neighbor_counts",
    """SELECT 'c_custkey=' || o_custkey AS hub_id, count(*) * (count(*) - 1) // 2 AS pairs
       FROM orders GROUP BY o_custkey HAVING count(*) > 1""",
)
def _(spark, sf):
    return match.shared_neighbor_counts(t.graph(spark, sf), "HAS_O_CUSTKEY", k=None)


_TOGETHER = """WITH e AS (SELECT DISTINCT {src} AS s, {dst} AS d FROM {table})
  SELECT x.d AS a, y.d AS b, count(*) AS together FROM e x JOIN e y ON x.s = y.s AND x.d < y.d
  GROUP BY x.d, y.d ORDER BY together DESC, a, b LIMIT 10"""


@query("co_occurrence", _TOGETHER.format(src="l_orderkey", dst="'p_partkey=' || l_partkey", table="lineitem"))
def _(spark, sf):
    return co_occurrence(t.order_part_graph(spark, sf), "ORDER_PART")


@query("co_occurrence_hot", _TOGETHER.format(src="l_linestatus", dst="'p_partkey=' || l_partkey", table="lineitem"))
def _(spark, sf):
    return co_occurrence(t.status_part_graph(spark, sf), "STATUS_PART")


@query("co_occurrence_own_sets", _TOGETHER.format(src="l_quantity::INT", dst="'p_partkey=' || l_partkey", table="lineitem"))
def _(spark, sf):
    return co_occurrence(t.quantity_part_graph(spark, sf), "QUANTITY_PART")


# one edge type that leaves two labels, and ids that both have

@query("shared_type_expand_out", "SELECT 'id=' || o_orderkey AS _id, 'value=' || o_orderpriority AS other_id FROM orders")
def _(spark, sf):
    graph = t.shared_graph(spark, sf)
    return match.expand(graph, graph.node("Order").select(ID), "HAS_KIND", from_label="Order")


@query("shared_type_expand_in", "SELECT DISTINCT 'value=' || event_type AS _id, 'id=' || event_id AS other_id FROM events")
def _(spark, sf):
    graph = t.shared_graph(spark, sf)
    return match.expand(graph, graph.node("Kind").select(ID), "HAS_KIND", "in", from_label="Event")


@query(
    "shared_type_expand_both",
    """SELECT 'id=' || o_orderkey AS _id, 'value=' || o_orderpriority AS other_id FROM orders
       UNION ALL SELECT 'value=' || o_orderpriority, 'id=' || o_orderkey FROM orders""",
)
def _(spark, sf):
    graph = t.shared_graph(spark, sf)
    both = graph.node("Order").select(ID).unionByName(graph.node("Kind").select(ID))
    return match.expand(graph, both, "HAS_KIND", "both", from_label="Order")


@query(
    "shared_type_sharing",
    "SELECT 'value=' || event_type AS hub_id, count(*) * (count(*) - 1) // 2 AS pairs FROM events GROUP BY event_type HAVING count(*) > 1",
)
def _(spark, sf):
    return match.shared_neighbor_counts(t.shared_graph(spark, sf), "HAS_KIND", k=None, from_label="Event")


@query("shared_type_busiest", "SELECT 'value=' || o_orderpriority AS target_id, count(*) AS degree FROM orders GROUP BY ALL ORDER BY degree DESC, target_id LIMIT 10")
def _(spark, sf):
    return match.busiest(t.shared_graph(spark, sf), "HAS_KIND", from_label="Order")


@query("shared_type_distinct", "SELECT 'value=' || event_type AS dst_id, count(DISTINCT event_id) AS neighbors FROM events GROUP BY event_type")
def _(spark, sf):
    return match.count_distinct_neighbors(t.shared_graph(spark, sf), "HAS_KIND", from_label="Event")


@query(
    "shared_type_two_hops",
    """SELECT 'value=' || o_orderpriority AS start_id, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS reached
       FROM orders GROUP BY o_orderpriority""",
)
def _(spark, sf):
    reached = match.collect_two_hops(t.shared_graph(spark, sf), "HAS_KIND", "HAS_STATE", label="Order")
    return reached.select("start_id", F.array_join("reached", ",").alias("reached"))


@query("busiest_hubs", "SELECT 'p_partkey=' || l_partkey AS target_id, count(DISTINCT l_orderkey) AS degree FROM lineitem GROUP BY l_partkey ORDER BY degree DESC, target_id LIMIT 10")
def _(spark, sf):
    return match.busiest(t.order_part_graph(spark, sf), "ORDER_PART")


@query(
    "sum_edge_property",
    """SELECT 'o_orderkey=' || l_orderkey AS source_id, sum(CAST(l_quantity AS DECIMAL(34,4))) AS total
       FROM lineitem GROUP BY l_orderkey ORDER BY total DESC, source_id LIMIT 10""",
)
def _(spark, sf):
    return match.sum_edge_property(t.order_part_graph(spark, sf), "ORDER_PART", "quantity", exact="decimal(38,4)")


@query(
    "expand_path",
    f"""WITH RECURSIVE e AS ({STAFF_EDGES}), p(start_id, end_id, hops, nodes) AS (
          SELECT src_id, dst_id, 1, src_id || '>' || dst_id FROM e
          UNION ALL SELECT start_id, e.dst_id, hops + 1, nodes || '>' || e.dst_id FROM p JOIN e ON e.src_id = p.end_id)
        SELECT start_id, end_id, hops, nodes FROM p""",
)
def _(spark, sf):
    graph = t.staff_graph(spark, sf)
    walked = paths.expand_path(graph, graph.node("Staff"), "HAS_MANAGER", 1, None)
    return walked.select("start_id", "end_id", "hops", F.array_join("nodes", ">").alias("nodes"))


@query(
    "shortest_path",
    f"""WITH RECURSIVE e AS ({STAFF_EDGES}), s AS (SELECT src_id AS a, dst_id AS b FROM e UNION ALL SELECT dst_id, src_id FROM e),
        p(place, hops, seen) AS (
          SELECT 'c_custkey=12', 0, ['c_custkey=12']
          UNION ALL SELECT s.b, hops + 1, list_append(seen, s.b) FROM p JOIN s ON s.a = p.place
          WHERE hops < 6 AND p.place <> 'c_custkey=135' AND NOT list_contains(seen, s.b))
        SELECT array_to_string(seen, '>') AS nodes, hops FROM p WHERE place = 'c_custkey=135' ORDER BY hops, seen LIMIT 1""",
)
def _(spark, sf):
    found = paths.shortest_path(t.staff_graph(spark, sf), ("Staff", "c_custkey=12"), ("Staff", "c_custkey=135"), 6)
    return found.select(F.array_join(F.transform("nodes", lambda n: n["id"]), ">").alias("nodes"), "hops")


# distances to the target first, then from the source always the smallest next node that is one step nearer
@query(
    "shortest_path_any_type",
    SALES.replace("WITH", "WITH RECURSIVE", 1) + """, steps AS (
      SELECT from_label AS al, src_id AS ai, type, to_label AS bl, dst_id AS bi FROM edges
      UNION ALL SELECT to_label, dst_id, type, from_label, src_id FROM edges),
    reached(l, i, h) AS (
      SELECT 'Region', 'r_regionkey=0', 0
      UNION SELECT al, ai, h + 1 FROM reached JOIN steps ON bl = l AND bi = i WHERE h < 6),
    best AS (SELECT l, i, min(h) AS h FROM reached GROUP BY ALL),
    walk(l, i, h, path) AS (
      SELECT l, i, h, l || ':' || i FROM best WHERE l = 'Order' AND i = 'o_orderkey=0'
      UNION ALL SELECT n.bl, n.bi, h - 1, path || ' ' || n.type || ' ' || n.bl || ':' || n.bi FROM (
        SELECT walk.h, path, min({'bl': bl, 'bi': bi, 'type': type}) AS n
        FROM walk JOIN steps ON al = walk.l AND ai = walk.i JOIN best ON best.l = bl AND best.i = bi AND best.h = walk.h - 1
        GROUP BY walk.h, path))
    SELECT path FROM walk WHERE h = 0""",
)
def _(spark, sf):
    found = paths.shortest_path(t.graph(spark, sf), ("Order", "o_orderkey=0"), ("Region", "r_regionkey=0"), 6)
    return results.paths_as_result(found).select(F.array_join("path", " ").alias("path"))


@query(
    "bounded_result",
    """SELECT count(*) AS row_count, (SELECT count(*) FROM orders) > 200 AS truncated, max(o_totalprice) AS highest, max(_id) AS last_id
       FROM (SELECT o_totalprice, 'o_orderkey=' || o_orderkey AS _id FROM orders ORDER BY o_totalprice DESC, _id LIMIT 200)""",
)
def _(spark, sf):
    orders = t.graph(spark, sf).node("Order").select(ID, "o_totalprice")
    result = results.bounded(orders.orderBy(F.desc("o_totalprice"), ID), 200)
    row = (result.row_count, result.truncated, max(r["o_totalprice"] for r in result.rows), max(r[ID] for r in result.rows))
    return spark.createDataFrame([row], "row_count bigint, truncated boolean, highest double, last_id string")


@query("node_results", "SELECT 'c_custkey=' || c_custkey AS _id, 'Customer' AS label, c_custkey::VARCHAR AS key_text, c_name AS name FROM customer")
def _(spark, sf):
    nodes = results.nodes_as_result(t.graph(spark, sf).node("Customer"), "Customer")
    props = F.col("node.props")
    return nodes.select(ID, "node.label", props["c_custkey"].alias("key_text"), props["c_name"].alias("name"))


@query(
    "edge_results",
    """SELECT 'o_orderkey=' || l_orderkey AS src_id, 'p_partkey=' || l_partkey AS dst_id, 'ORDER_PART' AS type,
              CAST(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS VARCHAR) AS quantity
       FROM lineitem GROUP BY l_orderkey, l_partkey""",
)
def _(spark, sf):
    edges = results.edges_as_result(t.order_part_graph(spark, sf).edge("ORDER_PART"), "ORDER_PART")
    return edges.select(SRC, DST, "edge.type", F.col("edge.props")["quantity"].alias("quantity"))


@query("unwind_lookup", "SELECT 'doc_id=' || d.doc_id AS _id, d.n_chars FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    keys = t.read(spark, sf, "labels").select(F.concat(F.lit("doc_id="), F.col("doc_id").cast("string")).alias(ID))
    return match.lookup(t.graph(spark, sf, ("documents",)), "Document", keys).select(ID, "n_chars")


# --- digest ----------------------------------------------------------------------------------

@query("label_counts", SALES + "SELECT label, count(*) AS count FROM nodes GROUP BY label")
def _(spark, sf):
    return digest.label_counts(t.graph(spark, sf))


@query("rel_type_counts", SALES + "SELECT type, count(*) AS count FROM edges GROUP BY type")
def _(spark, sf):
    return digest.rel_type_counts(t.graph(spark, sf))


@query("patterns", SALES + 'SELECT from_label AS "from", type, to_label AS "to", count(*) AS count FROM edges GROUP BY ALL')
def _(spark, sf):
    return digest.patterns(t.graph(spark, sf))


@query(
    "label_properties",
    """SELECT 'Order' AS label, 'o_orderdate,o_orderkey,o_totalprice' AS properties
       UNION ALL SELECT 'Customer', CASE WHEN count(c_acctbal) > 0 THEN 'c_acctbal,' ELSE '' END || 'c_custkey,c_name' FROM customer
       UNION ALL SELECT 'Nation', 'n_name,n_nationkey' UNION ALL SELECT 'Region', 'r_name,r_regionkey'
       UNION ALL SELECT 'CMktsegment', 'value' UNION ALL SELECT 'OOrderstatus', 'value' UNION ALL SELECT 'OOrderpriority', 'value'""",
)
def _(spark, sf):
    return digest.label_properties(t.graph(spark, sf)).select("label", F.array_join("properties", ",").alias("properties"))


@query(
    "dimension_values",
    """SELECT 'CMktsegment' AS label, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS values FROM customer
       UNION ALL SELECT 'OOrderstatus', string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) FROM orders
       UNION ALL SELECT 'OOrderpriority', string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) FROM orders""",
)
def _(spark, sf):
    return digest.dimension_values(t.graph(spark, sf)).select("label", F.array_join("values", "|").alias("values"))


@query(
    "graph_fingerprint",
    SALES + """SELECT substr(sha256(string_agg(label || ':' || n, '|' ORDER BY label)), 1, 16) AS fingerprint
    FROM (SELECT label, count(*) AS n FROM nodes GROUP BY label)""",
)
def _(spark, sf):
    return digest.fingerprint(t.graph(spark, sf))


# --- health ----------------------------------------------------------------------------------

@query("degrees", SALES + "SELECT label, _id, degree FROM degrees")
def _(spark, sf):
    return health.degrees(t.graph(spark, sf))


@query(
    "hub_idents",
    SALES + """SELECT label, rank, _id, degree, CASE WHEN _id LIKE 'value=%' THEN _id ELSE '' END AS ident FROM (
      SELECT label, _id, degree, CAST(row_number() OVER (PARTITION BY label ORDER BY degree DESC, _id) AS INTEGER) AS rank FROM degrees)
    WHERE rank <= 5""",
)
def _(spark, sf):
    hubs = health.top_hubs(t.graph(spark, sf))
    return hubs.select("label", "rank", ID, "degree", F.array_join("ident", ",").alias("ident"))


def _labelled_documents(spark, sf) -> PropertyGraph:
    """Documents with edges only from their labels: unlabelled ones are orphans."""
    graph = t.graph(spark, sf, ("documents", "labels"))
    return PropertyGraph(graph.nodes, {k: v for k, v in graph.edges.items() if k[0] == "Label"})


@query(
    "orphans",
    """SELECT 'Document' AS label, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS orphans FROM documents
       UNION ALL SELECT 'Label', CAST(0 AS BIGINT)
       UNION ALL SELECT 'Lang', count(DISTINCT lang) FROM documents UNION ALL SELECT 'Source', count(DISTINCT source) FROM documents""",
)
def _(spark, sf):
    return health.orphans(_labelled_documents(spark, sf))


@query("orphan_source_rows", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '5-LOW'")
def _(spark, sf):
    orders = t.spec(spark, sf, "orders", t.open_orders(spark, sf))
    return health.orphan_source_rows(orders, ["o_custkey"]).select("o_orderkey", "o_orderpriority")


def _shapes_graph(spark, sf) -> PropertyGraph:
    """Parts, the cheap ones without a size, beside hubs of the same label."""
    parts = t.collision_graph(spark, sf).node("Part")
    cheap = F.when(F.col("p_retailprice") > 1000, F.col("p_size")).alias("p_size")
    return PropertyGraph({"Part": parts.select(*[cheap if c == "p_size" else F.col(c) for c in parts.columns])}, {})


_PART_SHAPE = "p_name,p_partkey,p_retailprice,p_size"


def _part_shapes(columns: str) -> str:
    """Parts by shape; a shape without size is part of the one with it, if there is one."""
    return f"""WITH brands AS (SELECT count(DISTINCT p_brand) AS d, count(*) AS n FROM part),
      hub AS (SELECT d <= least(50, greatest(20, n // 10)) AS folded FROM brands),
      shapes AS (
        SELECT 'Part' AS label, CASE WHEN folded THEN '' ELSE 'p_brand,' END ||
          CASE WHEN (SELECT max(p_retailprice) FROM part) > 1000 THEN '{_PART_SHAPE}' ELSE 'p_name,p_partkey,p_retailprice' END AS shape,
          (SELECT count(*) FROM part) AS nodes FROM hub
        UNION ALL SELECT 'Part', 'value', count(DISTINCT p_type) FROM part)
      SELECT {columns} FROM shapes"""


@query("key_shapes", _part_shapes("label, shape, nodes"))
def _(spark, sf):
    return health.key_shapes(_shapes_graph(spark, sf)).select("label", F.array_join("shape", ",").alias("shape"), "nodes")


@query("mixed_key_shapes", _part_shapes("label, count(*) AS shapes, CAST(sum(nodes) AS BIGINT) AS nodes") + " GROUP BY label")
def _(spark, sf):
    return health.mixed_key_shapes(_shapes_graph(spark, sf))


@query(
    "generic_names",
    """SELECT 'label' AS kind, 'Entity' AS name, count(*) AS count FROM customer
       UNION ALL SELECT 'type', 'RELATED_TO', count(*) FROM customer""",
)
def _(spark, sf):
    vague = t.model(spark, sf, "customer").rename("Entity", {"HAS_C_NATIONKEY": "RELATED_TO"})
    return health.generic_names(build_graph([(t.spec(spark, sf, "customer"), vague)]))


@query(
    "missing_key_check",
    """SELECT 'Line' AS label, count(*) AS nodes, true AS declared,
              (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS repeated_keys
       FROM lineitem""",
)
def _(spark, sf):
    lines = t.read(spark, sf, "lineitem").select(F.to_json(F.struct("l_orderkey", "l_linenumber")).alias(ID))
    graph = t.graph(spark, sf).with_nodes("Line", lines)
    return health.missing_key_check(graph, declared=["Line", "Order", "Customer"])


@query(
    "supernodes",
    SALES + """SELECT label, count(*) AS nodes, max(degree) AS top_degree FROM degrees
    GROUP BY label HAVING count(*) <= 50 AND max(degree) > 100""",
)
def _(spark, sf):
    return health.supernodes(t.graph(spark, sf), degree=100)


@query(
    "degree_concentration",
    SALES + """SELECT label, CAST(sum(degree) FILTER (rank <= 5) AS BIGINT) AS top_ends, CAST(sum(degree) AS BIGINT) AS all_ends,
      round(sum(degree) FILTER (rank <= 5) / sum(degree), 4) AS share
    FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY degree DESC, _id) AS rank FROM degrees)
    GROUP BY label HAVING sum(degree) > 0""",
)
def _(spark, sf):
    return health.degree_concentration(t.graph(spark, sf))


@query(
    "health_guard",
    SALES + """SELECT label, count(*) AS count, count(*) > 1000 AS skipped FROM nodes GROUP BY label""",
)
def _(spark, sf):
    graph = t.graph(spark, sf)
    scanned, skipped = health.guarded(graph, max_nodes=1000)
    return digest.label_counts(scanned).withColumn("skipped", F.lit(False)).unionByName(skipped.withColumn("skipped", F.lit(True)))


# --- duplicates ------------------------------------------------------------------------------

def _documents(spark, sf):
    return dedupe.candidates(t.graph(spark, sf, ("documents",)).node("Document"), "text")


_NORM = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"

_COPIES = f"""copies AS (
    SELECT _id, norm, row_number() OVER (PARTITION BY norm ORDER BY substr(sha1(_id), 1, 3), _id) AS number
    FROM (SELECT 'doc_id=' || doc_id AS _id, {_NORM.format("text")} AS norm FROM documents)
    WHERE norm <> '')"""


def _capped_pairs(cap: int) -> str:
    return f"""SELECT least(x._id, y._id) AS a_id, greatest(x._id, y._id) AS b_id FROM copies x JOIN copies y
      ON x.norm = y.norm AND (x.number - 1) // {cap + 1} = (y.number - 1) // {cap + 1} AND x.number < y.number"""


@query(
    "exact_dup_groups",
    f"""SELECT sha256(norm) AS form, count(*) AS copies, min(_id) AS first_id, count(*) * (count(*) - 1) // 2 AS pairs
       FROM (SELECT 'doc_id=' || doc_id AS _id, {_NORM.format("text")} AS norm FROM documents)
       WHERE norm <> '' GROUP BY norm HAVING count(*) > 1""",
)
def _(spark, sf):
    return dedupe.exact_groups(_documents(spark, sf))


@query(
    "exact_dup_pairs",
    f"WITH {_COPIES} SELECT a_id, b_id, 0.99::DOUBLE AS confidence, 'exact-normalized' AS method FROM ({_capped_pairs(3)})",
)
def _(spark, sf):
    return dedupe.exact_pairs(_documents(spark, sf), cap=3).select("a_id", "b_id", "confidence", "method")


_STARS = "stars AS (SELECT _id, leader_id FROM (SELECT _id, min(_id) OVER (PARTITION BY norm) AS leader_id, count(*) OVER (PARTITION BY norm) AS n FROM copies) WHERE n > 1)"


@query("exact_dup_members", f"WITH {_COPIES}, {_STARS} SELECT _id, leader_id FROM stars")
def _(spark, sf):
    return dedupe.exact_members(_documents(spark, sf))


@query("exact_dup_capped", f"WITH {_COPIES} SELECT a_id, b_id FROM ({_capped_pairs(1)})")
def _(spark, sf):
    return dedupe.exact_pairs(_documents(spark, sf), cap=1).select("a_id", "b_id")


_NAME_PAIRS = f"""names AS (
    SELECT DISTINCT '' AS block, {tokens_sorted('p_name')} AS text FROM part WHERE {_NORM.format("p_name")} <> ''),
  scored AS (
    SELECT block, a, b, {ratio('a', 'b')} AS score FROM (
      SELECT x.block, x.text AS a, y.text AS b FROM names x JOIN names y ON x.block = y.block AND x.text < y.text))"""


@query("fuzzy_pairs", f"WITH {_NAME_PAIRS} SELECT block, a, b, score FROM scored WHERE score >= 0.7")
def _(spark, sf):
    parts = dedupe.candidates(t.graph(spark, sf, ("part",)).node("Part"), "p_name")
    return dedupe.value_pairs(parts, 0.7)


@query(
    "dup_bands",
    f"""WITH {_NAME_PAIRS} SELECT a, b, round(score, 4) AS confidence,
        CASE WHEN round(score, 4) >= 0.73 THEN 'merge_candidate' ELSE 'needs_review' END AS band FROM scored WHERE score >= 0.7""",
)
def _(spark, sf):
    parts = dedupe.candidates(t.graph(spark, sf, ("part",)).node("Part"), "p_name")
    pairs = dedupe.value_pairs(parts, 0.7).select("a", "b", F.round("score", 4).alias("confidence"))
    return dedupe.bands(pairs, 0.7, 0.73)


# the edit distance never exceeds the insert/delete distance, so the screen loses no pair
@query(
    "similar_urls",
    f"""WITH urls AS (SELECT DISTINCT {tokens_sorted('url')} AS text FROM pages WHERE {_NORM.format("url")} <> ''),
        near AS (SELECT x.text AS a, y.text AS b FROM urls x JOIN urls y ON x.text < y.text
          AND levenshtein(x.text, y.text) <= floor((1.0::DOUBLE - 0.9) * (length(x.text) + length(y.text)) + 1e-9)),
        scored AS (SELECT a, b, {ratio('a', 'b')} AS score FROM near)
        SELECT a, b, score FROM scored WHERE score >= 0.9""",
)
def _(spark, sf):
    """Every pair of similar web addresses of the pages."""
    pages = dedupe.candidates(t.graph(spark, sf, ("pages",)).node("Page"), "url")
    return dedupe.value_pairs(pages, 0.9).select("a", "b", "score")


# all pairs, best first, one recursion step each: a pair is taken while both ends have places left
@query(
    "dup_pairs_capped",
    f"""WITH RECURSIVE nodes AS (
      SELECT _id, {tokens_sorted('name')} AS text, norm, CAST(row_number() OVER (ORDER BY _id) AS INTEGER) AS n
      FROM (SELECT 's_suppkey=' || s_suppkey AS _id, s_name AS name, {_NORM.format("s_name")} AS norm FROM supplier) WHERE norm <> ''),
    scored AS (
      SELECT a_id, b_id, xn, yn, {ratio('a', 'b')} AS score FROM (
        SELECT x._id AS a_id, y._id AS b_id, x.n AS xn, y.n AS yn, x.text AS a, y.text AS b FROM nodes x JOIN nodes y ON x._id < y._id AND x.norm <> y.norm)),
    ranked AS (
      SELECT *, row_number() OVER (ORDER BY score DESC, md5(a_id || '|' || b_id), a_id, b_id) AS r
      FROM scored WHERE score >= 0.85),
    greedy(r, places, taken) AS (
      SELECT CAST(0 AS BIGINT), list_transform(range((SELECT count(*) FROM nodes)), lambda x: 3), false
      UNION ALL
      SELECT p.r, CASE WHEN places[xn] > 0 AND places[yn] > 0 THEN list_transform(places, lambda x, i: CASE WHEN i = xn OR i = yn THEN x - 1 ELSE x END) ELSE places END,
             places[xn] > 0 AND places[yn] > 0
      FROM greedy JOIN ranked p ON p.r = greedy.r + 1)
    SELECT a_id, b_id, round(score, 4) AS confidence, CASE WHEN round(score, 4) >= 0.95 THEN 'merge_candidate' ELSE 'needs_review' END AS band
    FROM ranked JOIN greedy USING (r) WHERE taken""",
)
def _(spark, sf):
    suppliers = dedupe.candidates(t.graph(spark, sf, ("supplier",)).node("Supplier"), "s_name")
    return dedupe.find_duplicates(suppliers, cap=3).select("a_id", "b_id", "confidence", "band")


def _reviewed(spark, sf) -> PropertyGraph:
    """Documents with a user's own SAME_AS edges, found pairs, and decisions on the pairs of a first run."""
    graph = t.graph(spark, sf, ("documents",))
    nodes = dedupe.candidates(graph.node("Document"), "text")
    found = dedupe.member_pairs(nodes)
    first = found.groupBy("a_id").agg(F.min("b_id").alias("b_id"), F.first("confidence").alias("confidence"), F.first("method").alias("method"))
    own = first.select(
        F.col("a_id").alias(SRC), F.col("b_id").alias(DST), F.lit("manual").alias("source"), F.lit(1.0).alias("confidence"),
        F.lit("by hand").alias("method"), F.lit("agreed").alias("status"), F.lit("text").alias("property"),
    )
    graph = graph.with_edges(("Document", dedupe.SAME_AS, "Document"), own)
    graph = dedupe.same_as_upsert(graph, "Document", first, "text")
    graph = dedupe.set_status(graph, "Document", first.select("a_id", "b_id", F.lit("confirmed").alias("status")))
    return dedupe.same_as_upsert(graph, "Document", found, "text")


_REVIEWED = f"""WITH {_COPIES}, {_STARS}, found AS (SELECT leader_id AS a_id, _id AS b_id FROM stars WHERE _id <> leader_id),
  first AS (SELECT a_id, min(b_id) AS b_id FROM found GROUP BY a_id),
  same_as AS (
    SELECT a_id AS src_id, b_id AS dst_id, 'manual' AS source, 1.0::DOUBLE AS confidence, 'agreed' AS status FROM first
    UNION ALL SELECT a_id, b_id, '{dedupe.SOURCE_TAG}', 0.99::DOUBLE,
      CASE WHEN (a_id, b_id) IN (SELECT (a_id, b_id) FROM first) THEN 'confirmed' ELSE 'pending' END FROM found)"""


@query("same_as_upsert", f"{_REVIEWED} SELECT src_id, dst_id, source, confidence, status FROM same_as")
def _(spark, sf):
    edges = _reviewed(spark, sf).edge(dedupe.SAME_AS)
    return edges.select(SRC, DST, "source", "confidence", "status")


@query(
    "same_as_clear",
    f"{_REVIEWED} SELECT count(*) FILTER (source <> 'manual') AS cleared_edges, count(*) FILTER (source = 'manual') AS kept_edges FROM same_as",
)
def _(spark, sf):
    graph, cleared = dedupe.same_as_clear(_reviewed(spark, sf), "Document")
    kept = graph.edge(dedupe.SAME_AS).agg(F.count(F.lit(1)).alias("kept_edges"))
    both = cleared.withColumn("kept_edges", F.lit(0).cast("bigint")).unionByName(kept.withColumn("cleared_edges", F.lit(0).cast("bigint")))
    return both.agg(F.sum("cleared_edges").alias("cleared_edges"), F.sum("kept_edges").alias("kept_edges"))


@query(
    "review_queue",
    f"""{_REVIEWED} SELECT src_id, dst_id, x.text AS a, y.text AS b, confidence, 'exact-normalized' AS method FROM same_as
        JOIN documents x ON src_id = 'doc_id=' || x.doc_id JOIN documents y ON dst_id = 'doc_id=' || y.doc_id
        WHERE same_as.source <> 'manual' AND status = 'pending'""",
)
def _(spark, sf):
    return dedupe.review_queue(_reviewed(spark, sf), "Document", "text")


@query(
    "set_status",
    f"""{_REVIEWED} SELECT src_id, dst_id, source, CASE WHEN source <> 'manual' AND status = 'pending' THEN 'rejected' ELSE status END AS status FROM same_as""",
)
def _(spark, sf):
    graph = _reviewed(spark, sf)
    queue = dedupe.review_queue(graph, "Document", "text")
    # given the wrong way round on purpose
    decisions = queue.select(F.col(DST).alias("a_id"), F.col(SRC).alias("b_id"), F.lit("rejected").alias("status"))
    return dedupe.set_status(graph, "Document", decisions).edge(dedupe.SAME_AS).select(SRC, DST, "source", "status")


# --- snapshot --------------------------------------------------------------------------------

_KEPT = SALES.rstrip() + ", kept AS (SELECT * FROM degrees ORDER BY degree DESC, label, _id LIMIT 400) "


@query("snapshot_nodes", _KEPT + "SELECT label, _id, degree FROM kept")
def _(spark, sf):
    return snapshot.snapshot_nodes(t.graph(spark, sf))


@query(
    "snapshot_edges",
    _KEPT + """SELECT e.* FROM edges e WHERE (from_label, src_id) IN (SELECT (label, _id) FROM kept)
      AND (to_label, dst_id) IN (SELECT (label, _id) FROM kept) ORDER BY from_label, src_id, type, to_label, dst_id LIMIT 1500""",
)
def _(spark, sf):
    graph = t.graph(spark, sf)
    return snapshot.snapshot_edges(graph, cut_lineage(snapshot.snapshot_nodes(graph)))


@query("snapshot_legend", _KEPT + "SELECT label, count(*) AS nodes FROM kept GROUP BY label")
def _(spark, sf):
    return snapshot.snapshot_legend(snapshot.snapshot_nodes(t.graph(spark, sf)))


@query(
    "snapshot_flags",
    _KEPT + """, among AS (SELECT count(*) AS n FROM edges WHERE (from_label, src_id) IN (SELECT (label, _id) FROM kept)
      AND (to_label, dst_id) IN (SELECT (label, _id) FROM kept))
    SELECT (SELECT count(*) FROM nodes) AS total_nodes, n AS edges_among, (SELECT count(*) FROM nodes) > 400 AS nodes_sampled,
           n > 1500 AS edges_sampled FROM among""",
)
def _(spark, sf):
    return snapshot.snapshot(t.graph(spark, sf)).flags


@query(
    "snapshot_props",
    _KEPT + """, props AS (
      SELECT 'Region' AS label, 'r_regionkey=' || r_regionkey AS _id, 'r_regionkey=' || r_regionkey || '|r_name=' || r_name AS props FROM region
      UNION ALL SELECT 'Nation', 'n_nationkey=' || n_nationkey, 'n_nationkey=' || n_nationkey || '|n_name=' || n_name FROM nation
      UNION ALL SELECT 'Customer', 'c_custkey=' || c_custkey, 'c_custkey=' || c_custkey || '|c_name=' || c_name || '|c_acctbal=' || c_acctbal FROM customer
      UNION ALL SELECT 'Order', 'o_orderkey=' || o_orderkey, 'o_orderkey=' || o_orderkey || '|o_totalprice=' || o_totalprice || '|o_orderdate=' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') FROM orders
      UNION ALL SELECT label, _id, _id FROM nodes WHERE _id LIKE 'value=%')
    SELECT label, _id, degree, props FROM kept JOIN props USING (label, _id)""",
)
def _(spark, sf):
    graph = t.graph(spark, sf)
    shown = snapshot.snapshot_props(graph, cut_lineage(snapshot.snapshot_nodes(graph)))
    text = F.transform("props", lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return shown.select("label", ID, "degree", F.array_join(text, "|").alias("props"))


@query("long_property_values", """SELECT 'doc_id=' || doc_id AS _id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '…' ELSE text END AS text FROM documents""")
def _(spark, sf):
    return t.graph(spark, sf, ("documents",)).node("Document").select(ID, truncate_value(F.col("text")).alias("text"))


# --- reports of several parts, as one long frame ---------------------------------------------

def _long(parts: dict, **columns) -> DataFrame:
    """(part, name, value) rows: for each part the name and value columns given."""
    rows = [
        parts[part].select(F.lit(part).alias("part"), F.concat_ws(" ", *names).alias("name"), F.col(value).cast("string").alias("value"))
        for part, (names, value) in columns.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@query(
    "digest_report",
    SALES + """, counted AS (SELECT label, count(*) AS n FROM nodes GROUP BY label)
    SELECT 'labels' AS part, label AS name, CAST(n AS VARCHAR) AS value FROM counted
    UNION ALL SELECT 'relationships', type, CAST(count(*) AS VARCHAR) FROM edges GROUP BY type
    UNION ALL SELECT 'patterns', from_label || ' ' || type || ' ' || to_label, CAST(count(*) AS VARCHAR) FROM edges GROUP BY ALL
    UNION ALL SELECT 'properties', 'Order', 'o_orderdate,o_orderkey,o_totalprice'
    UNION ALL SELECT 'properties', 'Customer', CASE WHEN count(c_acctbal) > 0 THEN 'c_acctbal,' ELSE '' END || 'c_custkey,c_name' FROM customer
    UNION ALL SELECT 'properties', 'Nation', 'n_name,n_nationkey' UNION ALL SELECT 'properties', 'Region', 'r_name,r_regionkey'
    UNION ALL SELECT 'properties', l, 'value' FROM (VALUES ('CMktsegment'), ('OOrderstatus'), ('OOrderpriority')) v(l)
    UNION ALL SELECT 'dimension_values', label, string_agg(substr(_id, 7), ',' ORDER BY _id) FROM nodes WHERE _id LIKE 'value=%' GROUP BY label
    UNION ALL SELECT 'fingerprint', '', substr(sha256(string_agg(label || ':' || n, '|' ORDER BY label)), 1, 16) FROM counted""",
)
def _(spark, sf):
    parts = digest.digest(t.graph(spark, sf))
    for part, column in (("properties", "properties"), ("dimension_values", "values")):
        parts[part] = parts[part].withColumn(column, F.array_join(column, ","))
    return _long(
        parts, labels=(["label"], "count"), relationships=(["type"], "count"), patterns=(["from", "type", "to"], "count"),
        properties=(["label"], "properties"), dimension_values=(["label"], "values"), fingerprint=([], "fingerprint"),
    )


@query(
    "health_report",
    SALES + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY degree DESC, _id) AS rank FROM degrees)
    SELECT 'labels' AS part, label AS name, CAST(count(*) AS VARCHAR) AS value FROM nodes GROUP BY label
    UNION ALL SELECT 'relationship_types', type, CAST(count(*) AS VARCHAR) FROM edges GROUP BY type
    UNION ALL SELECT 'top_hubs', label || ' ' || _id, CAST(degree AS VARCHAR) FROM ranked WHERE rank <= 5
    UNION ALL SELECT 'orphans', label, CAST(count(*) FILTER (degree = 0) AS VARCHAR) FROM degrees GROUP BY label
    UNION ALL SELECT 'degree_concentration', label, CAST(CAST(sum(degree) FILTER (rank <= 5) AS BIGINT) AS VARCHAR) FROM ranked GROUP BY label HAVING sum(degree) > 0
    UNION ALL SELECT 'missing_keys', label, CAST(count(*) AS VARCHAR) FROM nodes GROUP BY label HAVING count(*) > 1000""",
)
def _(spark, sf):
    return _long(
        health.health(t.graph(spark, sf)), labels=(["label"], "count"), relationship_types=(["type"], "count"), top_hubs=(["label", ID], "degree"),
        orphans=(["label"], "orphans"), degree_concentration=(["label"], "top_ends"), missing_keys=(["label"], "nodes"),
    )
