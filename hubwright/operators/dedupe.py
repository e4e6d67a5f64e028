"""Near-duplicate nodes as reviewable SAME_AS edges.

Nodes whose values are equal after normalisation are copies of the first of them: ``exact_members``
names that for each, linear in the nodes whatever a group's size. A second phase finds similar values.

With a ``cap`` each node takes part in at most so many pairs over both phases, better ones
first: copies, then pairs by falling score, equal scores by an MD5 digest of both ids.
The result is the one a sequential greedy pass in that order gives, found in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hubwright.functions.text import canonical_order, normalize_text, token_sort
from hubwright.functions.values import to_text
from hubwright.operators.graph import DST, EDGE_ENDS, ID, SRC, PropertyGraph
from hubwright.operators.similarity import similar_pairs
from hubwright.session import cut_lineage, stage_table

SOURCE_TAG = "hubwright-dedupe"
SAME_AS = "SAME_AS"
PENDING = "pending"
STATUSES = (PENDING, "confirmed", "rejected")

REVIEW = 0.85
HIGH = 0.95
EXACT_CONFIDENCE = 0.99
EXACT = "exact-normalized"
FUZZY = "fuzzy-token-sort"

SHARD_DIGITS = 3  # hex digits of the id's hash: 4096 shards for the copies of one value


def candidates(frame: DataFrame, prop: str, keep_unicode: bool = True) -> DataFrame:
    """Nodes that have the property: ``_id``, its text and its normal form. All of them, not a first few thousand."""
    text = to_text(F.col(f"`{prop}`"), frame.schema[prop].dataType)
    named = frame.where(F.col(f"`{prop}`").isNotNull()).select(ID, text.alias("text"))
    return named.withColumn("norm", normalize_text(F.col("text"), keep_unicode))


def _forms(nodes: DataFrame) -> DataFrame:
    """Nodes with a digest of their normal form. Values may be whole texts; 64 characters are shuffled in their place."""
    return nodes.where("norm != ''").select(ID, F.sha2("norm", 256).alias("form"))


def exact_groups(nodes: DataFrame) -> DataFrame:
    """Every normal form with copies, by its digest: how many there are, the first of them, and the pairs they stand for."""
    groups = _forms(nodes).groupBy("form").agg(F.count(F.lit(1)).alias("copies"), F.min(ID).alias("first_id"))
    return groups.where("copies > 1").withColumn("pairs", F.expr("copies * (copies - 1) div 2"))


def exact_members(nodes: DataFrame) -> DataFrame:
    """Every copy of a value with its leader, the first of them: ``_id``, ``leader_id``. A leader leads itself; single values are left out."""
    forms = stage_table(_forms(nodes))
    leaders = forms.groupBy("form").agg(F.count(F.lit(1)).alias("copies"), F.min(ID).alias("leader_id")).where("copies > 1")
    return forms.join(leaders, "form").select(ID, "leader_id")


def member_pairs(nodes: DataFrame) -> DataFrame:
    """Each copy paired with its leader: star edges that link all copies of a value."""
    stars = exact_members(nodes).where(F.col(ID) != F.col("leader_id"))
    return stars.select(F.col("leader_id").alias("a_id"), F.col(ID).alias("b_id"), F.lit(EXACT_CONFIDENCE).alias("confidence"), F.lit(EXACT).alias("method"))


def _numbered(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """``number``, from 1 within each group of ``by``, in order of (shard, order); groups of one row are left out.

    A group that a third of all rows share would be one window partition. Its rows are numbered within their
    ``shard`` instead, and each shard starts where the shards before it end. ``rows``: written before, as they are used twice.
    """
    group = Window.partitionBy(*by)
    before = group.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*by, "shard")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("copies", F.sum("n").over(group))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where("copies > 1")
        .select(*by, "shard", "start")
    )
    within = F.row_number().over(Window.partitionBy(*by, "shard").orderBy(*order))
    return rows.join(starts, [*by, "shard"]).withColumn("number", F.col("start") + within).drop("start", "shard")


def numbered_copies(nodes: DataFrame) -> DataFrame:
    """Number the copies of each normal form from 1, in order of (shard of the id's hash, id); single values are left out."""
    # written once: both uses would otherwise normalise all texts again
    forms = stage_table(_forms(nodes))
    rows = forms.withColumn("shard", F.substring(F.sha1(F.col(ID).cast("binary")), 1, SHARD_DIGITS))
    return _numbered(rows, ["form"], [ID]).select(ID, "form", "number")


def _chunks(nodes: DataFrame, cap: int) -> DataFrame:
    """Runs of cap+1 copies, each collected into one short array."""
    chunk = F.expr(f"(number - 1) div {cap + 1}")
    return (
        numbered_copies(nodes)
        .groupBy("form", chunk.alias("chunk"))
        .agg(F.array_sort(F.collect_list(ID)).alias("members"))
    )


def _pairs_within(chunks: DataFrame) -> DataFrame:
    """All pairs of each run, smaller id first."""
    rest = lambda i: F.slice("members", i + 2, F.size("members"))
    both = F.flatten(
        F.transform("members", lambda a, i: F.transform(rest(i), lambda b: F.struct(a.alias("a_id"), b.alias("b_id"))))
    )
    pairs = chunks.select(F.inline(both))
    return pairs.select("a_id", "b_id", F.lit(EXACT_CONFIDENCE).alias("score"), F.lit(EXACT).alias("method"))


def _with_confidence(pairs: DataFrame) -> DataFrame:
    return pairs.select("a_id", "b_id", F.round("score", 4).alias("confidence"), "method")


def with_values(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with the values of both ends. Looked up at the end, for the nodes in pairs only."""
    ids = pairs.select(F.explode(F.array("a_id", "b_id")).alias(ID)).distinct()
    nodes = nodes.join(ids, ID, "left_semi")
    for end in ("a", "b"):
        value = nodes.select(F.col(ID).alias(f"{end}_id"), F.col("text").alias(f"{end}_value"))
        pairs = pairs.join(value, f"{end}_id")
    return pairs


def exact_pairs(nodes: DataFrame, cap: int) -> DataFrame:
    """Pairs of equal normal form with at most ``cap`` per node.

    A greedy pass over a group pairs off its first cap+1 members completely,
    then the next cap+1, and so on: that is known without building other pairs.
    """
    if cap < 1:
        raise ValueError("need cap >= 1")
    return _with_confidence(_pairs_within(_chunks(nodes, cap)))


def first_character(norm):
    return F.substring(norm, 1, 1)


def one_block(norm):
    return F.lit("")


def value_pairs(nodes: DataFrame, threshold: float = REVIEW, block=one_block) -> DataFrame:
    """Similar pairs of distinct token-sorted values, uncapped: ``block``, ``a``, ``b``, ``score``.

    A ``block``, such as ``first_character``, confines pairs to values that share it.
    """
    return similar_pairs(_values(nodes, block), threshold)


def _values(nodes: DataFrame, block) -> DataFrame:
    return nodes.where("norm != ''").select(block(F.col("norm")).alias("block"), token_sort(F.col("text")).alias("text")).distinct()


def _words(text):
    return F.unhex(F.md5(text))


def _open_nodes(nodes: DataFrame, chunks: DataFrame, cap: int, block) -> DataFrame:
    """Nodes with free places: all single values, and the last incomplete run of each group. Values as digests."""
    used = chunks.select(F.explode("members").alias(ID), (F.lit(cap + 1) - F.size("members")).alias("left"))
    free = nodes.where("norm != ''").select(
        ID, _words("norm").alias("form"), block(F.col("norm")).alias("block"), _words(token_sort(F.col("text"))).alias("words")
    )
    free = free.join(used, ID, "left").withColumn("left", F.coalesce("left", F.lit(cap)))
    return free.where("left > 0").select(ID, "left", "form", "block", "words")


def _accept(pairs: DataFrame, cap: int) -> DataFrame:
    """Greedy choice among scored pairs, in rounds.

    A pair that ranks within the free places at both of its ends cannot be
    displaced by any other, so all such pairs are taken at once. The best pair
    is always one of them, so every round makes progress. Equal scores go by a
    digest of the pair, which is as good as a random order: in order of the ids a chain of
    neighbouring values would be settled one pair per round.
    """
    pairs = pairs.withColumn("lot", F.md5(F.concat_ws("|", "a_id", "b_id").cast("binary")))
    accepted, rounds = None, 0
    rest = cut_lineage(pairs)
    while not rest.isEmpty():
        rounds += 1
        both = [F.struct(F.col(f"{end}_id").alias("end"), F.col(f"{end}_left").alias("left")) for end in ("a", "b")]
        ends = rest.select("a_id", "b_id", "score", "lot", F.inline(F.array(*both)))
        order = Window.partitionBy("end").orderBy(F.desc("score"), "lot", "a_id", "b_id")
        # the constant bound lets every task drop all but cap rows per node before the shuffle
        ranked = ends.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)
        chosen = (
            ranked.where(F.col("rank") <= F.col("left"))
            .groupBy("a_id", "b_id")
            .agg(F.count(F.lit(1)).alias("n"))
            .where("n = 2")
            .select("a_id", "b_id")
        )
        chosen = cut_lineage(chosen)
        taken = rest.join(chosen, ["a_id", "b_id"], "left_semi")
        accepted = taken if accepted is None else accepted.unionByName(taken)
        if rounds % 10 == 0:
            accepted = cut_lineage(accepted)
        used = chosen.select(F.explode(F.array("a_id", "b_id")).alias("end")).groupBy("end").agg(F.count(F.lit(1)).alias("used"))
        rest = rest.join(chosen, ["a_id", "b_id"], "left_anti")
        for end in ("a", "b"):
            spent = used.select(F.col("end").alias(f"{end}_id"), F.col("used").alias("_used"))
            rest = (
                rest.join(spent, f"{end}_id", "left")
                .withColumn(f"{end}_left", F.col(f"{end}_left") - F.coalesce("_used", F.lit(0)))
                .drop("_used")
            )
        rest = cut_lineage(rest.where("a_left > 0 and b_left > 0"))
    return accepted if accepted is not None else pairs.limit(0)


def _with_places(pairs: DataFrame, score) -> DataFrame:
    """Pairs of nodes x and y as scored pairs with free places, smaller id first."""
    kept = F.col(f"x_{ID}") < F.col(f"y_{ID}")
    a, b = canonical_order(F.col(f"x_{ID}"), F.col(f"y_{ID}"))
    places = F.when(kept, F.col("x_left")).otherwise(F.col("y_left")), F.when(kept, F.col("y_left")).otherwise(F.col("x_left"))
    return pairs.select(a.alias("a_id"), b.alias("b_id"), places[0].alias("a_left"), places[1].alias("b_left"), score.alias("score"))


def _same_words(open_nodes: DataFrame, cap: int) -> DataFrame:
    """Pairs of nodes that hold the same words in another order, each with its next ``2 * cap + 2`` by the ids' digests.

    As many as there are nodes. Each node fills up within that window unless its group ends.
    """
    window = 2 * cap + 2
    lot = F.md5(F.col(ID).cast("binary"))
    # the shard is the start of the digest, so numbers are in the digests' order
    rows = stage_table(open_nodes.withColumn("shard", F.substring(lot, 1, SHARD_DIGITS)))
    numbered = _numbered(rows, ["block", "words"], [lot, ID]).withColumn("number", F.col("number") - 1)
    run = F.expr(f"number div {window}")
    x = numbered.withColumn("run", F.explode(F.array(run, run + 1)))
    y = numbered.withColumn("run", run)
    names = [ID, "form", "left", "number"]
    keys = ["block", "words", "run"]
    met = x.select(*keys, *[F.col(c).alias(f"x_{c}") for c in names]).join(y.select(*keys, *[F.col(c).alias(f"y_{c}") for c in names]), keys)
    ahead = F.col("y_number") - F.col("x_number")
    met = met.where((ahead > 0) & (ahead <= window) & (F.col("x_form") != F.col("y_form")))
    return _with_places(met, F.lit(1.0))


def _node_pairs(open_nodes: DataFrame, values: DataFrame) -> DataFrame:
    """Scored pairs of open nodes for similar values."""
    pairs = values.select("block", _words("a").alias("x_words"), _words("b").alias("y_words"), "score")
    for end in ("x", "y"):
        nodes = open_nodes.select("block", F.col("words").alias(f"{end}_words"), *[F.col(c).alias(f"{end}_{c}") for c in (ID, "form", "left")])
        pairs = pairs.join(nodes, ["block", f"{end}_words"])
    pairs = pairs.where(F.col("x_form") != F.col("y_form"))
    return _with_places(pairs, F.col("score"))


def score_bands(review: float) -> list[float]:
    """Falling lower ends of score bands, the last one ``review``."""
    steps = [t / 100 for t in range(95, 0, -5) if t / 100 > review]
    return [*steps, review]


def find_duplicates(nodes: DataFrame, review: float = REVIEW, high: float = HIGH, cap: int | None = None, block=one_block) -> DataFrame:
    """Pairs of both phases with confidence, method and band. Writes nothing; see ``same_as_upsert``.

    Without a ``cap`` every copy is paired with its leader, and similar values are paired through the first node of each.
    With one, scores are gone through in falling bands: all pairs of a band are taken greedily,
    full nodes are dropped, and the next band is searched among the rest.
    """
    check_thresholds(review, high)
    if cap is None:
        return bands(with_values(member_pairs(nodes).unionByName(_leading_pairs(nodes, review, block)), nodes), review, high)
    if cap < 1:
        raise ValueError("need cap >= 1")
    chunks = cut_lineage(_chunks(nodes, cap))
    found = _pairs_within(chunks)
    open_nodes = cut_lineage(_open_nodes(nodes, chunks, cap, block))
    values = stage_table(_values(nodes, block).withColumn("words", _words("text")))
    above = None
    for lowest in [None, *score_bands(review)]:
        if lowest is None:
            pairs = _same_words(open_nodes, cap)
        else:
            rest = values.join(open_nodes.select("block", "words").distinct(), ["block", "words"], "left_semi")
            similar = similar_pairs(rest.select("block", "text"), lowest)
            # pairs above were settled by the bands before
            pairs = _node_pairs(open_nodes, similar if above is None else similar.where(F.col("score") < above))
            above = lowest
        taken = cut_lineage(_accept(pairs, cap).select("a_id", "b_id", "score"))
        found = found.unionByName(taken.withColumn("method", F.lit(FUZZY)))
        used = taken.select(F.explode(F.array("a_id", "b_id")).alias(ID)).groupBy(ID).agg(F.count(F.lit(1)).alias("used"))
        open_nodes = cut_lineage(
            open_nodes.join(used, ID, "left")
            .withColumn("left", F.col("left") - F.coalesce("used", F.lit(0)))
            .drop("used")
            .where("left > 0")
        )
    return bands(with_values(_with_confidence(found), nodes), review, high)


def _leading_pairs(nodes: DataFrame, review: float, block) -> DataFrame:
    """Similar values paired through the first node of each; nodes of the same words in another order through the first of all."""
    named = nodes.where("norm != ''").select(
        ID, _words("norm").alias("form"), block(F.col("norm")).alias("block"), _words(token_sort(F.col("text"))).alias("words")
    )
    forms = named.groupBy("block", "words", "form").agg(F.min(ID).alias(ID))
    forms = stage_table(forms.withColumn("first", F.min(ID).over(Window.partitionBy("block", "words"))))
    same = forms.where(F.col(ID) != F.col("first")).select(F.col("first").alias("a_id"), F.col(ID).alias("b_id"), F.lit(1.0).alias("score"))
    pairs = value_pairs(nodes, review, block).select("block", _words("a").alias("x"), _words("b").alias("y"), "score")
    for end in ("x", "y"):
        first = forms.where(F.col(ID) == F.col("first")).select("block", F.col("words").alias(end), F.col(ID).alias(f"{end}_id"))
        pairs = pairs.join(first, ["block", end])
    a, b = canonical_order(F.col("x_id"), F.col("y_id"))
    similar = pairs.where("x_id != y_id").groupBy(a.alias("a_id"), b.alias("b_id")).agg(F.max("score").alias("score"))
    return _with_confidence(same.unionByName(similar).withColumn("method", F.lit(FUZZY)))


def check_thresholds(review: float, high: float) -> None:
    if not 0 < review <= high <= 1:
        raise ValueError(f"thresholds have to rise from above 0 to at most 1: review {review}, high {high}")


def bands(pairs: DataFrame, review: float = REVIEW, high: float = HIGH) -> DataFrame:
    """Merge candidates from ``high`` up by rounded confidence, the rest to review."""
    check_thresholds(review, high)
    return pairs.withColumn("band", F.when(F.col("confidence") >= high, "merge_candidate").otherwise("needs_review"))


def _same_as(graph: PropertyGraph, label: str) -> DataFrame:
    key = (label, SAME_AS, label)
    schema = "src_id string, dst_id string, source string, confidence double, method string, status string, property string"
    if key in graph.edges:
        return graph.edges[key]
    return graph.node(label).sparkSession.createDataFrame([], schema)


def _tagged():
    return F.col("source").eqNullSafe(F.lit(SOURCE_TAG))


def same_as_upsert(graph: PropertyGraph, label: str, pairs: DataFrame, prop: str) -> PropertyGraph:
    """Write pairs as tagged SAME_AS edges; reviewed ones keep their status, untagged edges stay as they are."""
    old = _same_as(graph, label)
    new = pairs.select(
        F.col("a_id").alias(SRC), F.col("b_id").alias(DST), F.lit(SOURCE_TAG).alias("source"),
        "confidence", "method", F.lit(prop).alias("property"),
    )
    mine = old.where(_tagged())
    known = mine.select(SRC, DST, "status")
    written = new.join(known, list(EDGE_ENDS), "left").withColumn("status", F.coalesce("status", F.lit(PENDING)))
    kept = old.where(~_tagged()).unionByName(mine.join(new.select(*EDGE_ENDS), list(EDGE_ENDS), "left_anti"))
    return graph.with_edges((label, SAME_AS, label), kept.unionByName(written, allowMissingColumns=True))


def same_as_clear(graph: PropertyGraph, label: str) -> tuple[PropertyGraph, DataFrame]:
    """Remove the tagged edges of a label; returns the graph and how many there were."""
    old = _same_as(graph, label)
    cleared = old.agg(F.count_if(_tagged()).alias("cleared_edges"))
    return graph.with_edges((label, SAME_AS, label), old.where(~_tagged())), cleared


def review_queue(graph: PropertyGraph, label: str, prop: str) -> DataFrame:
    """Pending tagged edges with both values, best first."""
    pending = _same_as(graph, label).where(_tagged() & (F.col("status") == PENDING))
    value = graph.node(label).select(ID, F.col(f"`{prop}`"))
    a = value.select(F.col(ID).alias(SRC), F.col(prop).alias("a"))
    b = value.select(F.col(ID).alias(DST), F.col(prop).alias("b"))
    queue = pending.join(a, SRC).join(b, DST)
    return queue.select(SRC, DST, "a", "b", "confidence", "method").orderBy(F.desc("confidence"), SRC, DST)


def set_status(graph: PropertyGraph, label: str, decisions: DataFrame) -> PropertyGraph:
    """Record decisions (``a_id``, ``b_id``, ``status``) on tagged edges."""
    a, b = canonical_order(F.col("a_id"), F.col("b_id"))
    decided = decisions.select(a.alias(SRC), b.alias(DST), F.col("status").alias("_decided"))
    edges = _same_as(graph, label).join(decided, list(EDGE_ENDS), "left")
    status = F.when(_tagged(), F.coalesce("_decided", "status")).otherwise(F.col("status"))
    return graph.with_edges((label, SAME_AS, label), edges.withColumn("status", status).drop("_decided"))
