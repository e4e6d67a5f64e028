"""SimHash near-duplicates: a self-join of the fingerprints' binary trie.

1. ``fingerprints``: one 64-bit fingerprint per whole text, from hashed word shingles.
2. ``plan_cells``: the top of the trie. Nodes are counted by prefix, and only nodes with
   more fingerprints than a cell may hold are opened further. Cells are numbered prefixes,
   a bounded number whatever the corpus; two cells meet if their prefixes differ in no more
   bits than the budget.
3. ``cell_links``: one task per pair of cells goes on from there: it walks pairs of
   nodes together, adds up the differing bits, and drops a pair above the budget.
   It returns a spanning forest of its links, never all pairs of a group.
4. ``components``: links of all tasks are joined to components by alternating stars.

Equal fingerprints meet once, as one row, before any join. No link between different
fingerprints is lost, and no group is cut.

Defined results: a null text counts as empty; a text without words has fingerprint
zero, which links like any other; fewer words than a shingle are one shingle; rows that
repeat are separate members; a component without any id has a null component_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hubwright.llm.common import free_name, or_empty, table, values as each
from hubwright.session import stage_table

BITS = 64
SHINGLE_WORDS = 3
MAX_DIFFERING = 2
SEED = 42

#: A cell holds at most so many fingerprints, or the CELLS-th part of all where that is more.
CELL_ROWS, CELLS = 1 << 16, 1 << 11
#: Bits by which the trie's top is opened in one count.
STEP = 6
#: Node pairs that a task walks at once, and the pairs of fingerprints below which it compares them directly.
WALK, DIRECT = 1 << 18, 16

_ALL = (1 << BITS) - 1
_BYTE_PLACES = 256 * np.arange(8, dtype=np.int64)
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one whole text."""
    # bytes: lower() and split() then know ASCII only, as the definition asks
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    first, last = starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(first))
    # how often each of the eight bytes has each value, then bits of bytes
    bytes_ = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((bytes_ + _BYTE_PLACES).ravel(), minlength=8 * 256).reshape(8, 256)
    ones = (counts @ _BITS_OF_BYTE).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint_of(text: str | Column, words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint's 64 bits as a signed long."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        made = np.fromiter((fingerprint(t, words) for t in each(texts)), np.uint64, len(texts))
        return pa.array(made.view(np.int64))

    return run(or_empty(text))


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("fingerprint", BITS - depth) if depth else F.lit(0).cast("long")


def plan_cells(values: DataFrame, total: int, cell_rows: int = CELL_ROWS, most_cells: int = CELLS) -> list[tuple[int, int]]:
    """The trie's leaves as cells: (depth, prefix), disjoint and together everything.

    What reaches the driver are counts of children of overfull nodes. There are at most
    ``most_cells`` overfull nodes on a level, as each holds more than that part of all.
    """
    limit = max(cell_rows, total // most_cells)
    cells: list[tuple[int, int]] = []
    overfull, depth = [0] if total > limit else [], 0
    if not overfull:
        return [(0, 0)]
    while overfull:
        step = min(STEP, BITS - depth)
        inside = values.where(_prefix(depth).isin(overfull)) if depth else values
        counted = {p & _ALL: n for p, n in inside.groupBy(_prefix(depth + step).alias("prefix")).count().collect()}
        nxt: list[int] = []
        for node in overfull:
            stack = [(depth, node)]
            while stack:
                d, p = stack.pop()
                shift = depth + step - d
                n = sum(counted.get(c, 0) for c in range(p << shift, (p + 1) << shift))
                if n <= limit or d == BITS:
                    cells.append((d, p))
                elif d < depth + step:
                    stack += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
                else:
                    nxt.append(p)
        overfull, depth = nxt, depth + step
    return sorted(cells, key=lambda c: c[1] << (BITS - c[0]))


def meeting(cells: list[tuple[int, int]], budget: int) -> list[np.ndarray]:
    """For each cell the numbers of its pairs; pair (i, j), i <= j, is i * len(cells) + j."""
    low = np.array([p << (BITS - d) if d else 0 for d, p in cells], np.uint64)
    mask = np.array([((1 << d) - 1) << (BITS - d) for d, _ in cells], np.uint64)
    out = []
    for i in range(len(cells)):
        near = np.flatnonzero(np.bitwise_count((low ^ low[i]) & mask & mask[i]) <= budget)
        out.append(np.minimum(near, i) * len(cells) + np.maximum(near, i))
    return out


def _halves(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """For each node [lo, hi) of the sorted values, where its right child begins."""
    bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
    base = values[lo] & ~(bit | (bit - np.uint64(1)))
    return np.clip(np.searchsorted(values, base | bit), lo, hi)


def walk(a: np.ndarray, b: np.ndarray, same: bool, depth: int, differing: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into sorted ``a`` and ``b``) of values within the budget. ``same``: b is a, and each pair comes once.

    ``depth`` and ``differing``: the bits that all pairs of the two cells share as their way from the root.
    """
    if not len(a) or not len(b):
        return
    start = np.array([[0, len(a), 0, len(b), differing]], np.int64)
    todo = [(depth, start)]
    while todo:
        depth, pairs = todo.pop()
        if len(pairs) > WALK:
            todo += [(depth, pairs[at : at + WALK]) for at in range(0, len(pairs), WALK)]
            continue
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= DIRECT
        if depth >= BITS:
            small[:] = True
        done, pairs = pairs[small], pairs[~small]
        if len(done):
            n = (done[:, 1] - done[:, 0]) * (done[:, 3] - done[:, 2])
            node = np.repeat(np.arange(len(done)), n)
            at = np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n)
            width = (done[:, 3] - done[:, 2])[node]
            i, j = done[node, 0] + at // width, done[node, 2] + at % width
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        if not len(pairs):
            continue
        alo, ahi, blo, bhi, bits = pairs.T
        amid, bmid = _halves(a, alo, ahi, depth), _halves(b, blo, bhi, depth)
        children = []
        for x0, x1, ax in ((alo, amid, 0), (amid, ahi, 1)):
            for y0, y1, by in ((blo, bmid, 0), (bmid, bhi, 1)):
                keep = (x0 < x1) & (y0 < y1) & (bits + (ax ^ by) <= budget)
                if same:  # the mirror image of a pair of nodes is left out
                    keep &= x0 <= y0
                if keep.any():
                    children.append(np.stack([x0, x1, y0, y1, bits + (ax ^ by)], axis=1)[keep])
        if children:
            todo.append((depth + 1, np.concatenate(children)))


class Forest:
    """Components of numbered nodes, joined by blocks of links."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        at = self.parent[nodes]
        while (up := self.parent[at] != at).any():
            at = np.where(up, self.parent[at], at)
        return at

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = self.roots(i), self.roots(j)
        while (open_ := i != j).any():
            low, high = np.minimum(i[open_], j[open_]), np.maximum(i[open_], j[open_])
            np.minimum.at(self.parent, high, low)
            i, j = self.roots(high), self.roots(low)


def cell_links(values: DataFrame, cells: list[tuple[int, int]], budget: int = MAX_DIFFERING) -> DataFrame:
    """Links (src, dst), dst the smaller, that span every component within each pair of cells."""
    pairs = meeting(cells, budget)
    lows = np.array([p << (BITS - d) if d else 0 for d, p in cells], np.uint64)
    n = len(cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each pair of cells that a fingerprint's cell is part of."""
        sizes = np.array([len(p) for p in pairs])
        for batch in batches:
            known = batch.column(0).to_numpy()
            cell = np.searchsorted(lows, known.view(np.uint64), side="right") - 1
            for part in range(0, len(known), 1 << 14):
                own = cell[part : part + (1 << 14)]
                if len(own):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([pairs[c] for c in own])), pa.array(np.repeat(known[part : part + (1 << 14)], sizes[own]))],
                        ["pair", "fingerprint"],
                    )

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        i, j = divmod(int(group["pair"].iloc[0]), n)
        found = np.sort(group["fingerprint"].to_numpy(np.int64).view(np.uint64))
        if i == j:
            split, depth, bits = len(found), cells[i][0], 0
            a = b = found
        else:
            split = int(np.searchsorted(found, lows[j]))
            a, b = found[:split], found[split:]
            depth = min(cells[i][0], cells[j][0])
            bits = int((int(lows[i]) ^ int(lows[j])) >> (BITS - depth)).bit_count() if depth else 0
        forest = Forest(len(found))
        for x, y in walk(a, b, i == j, depth, bits, budget):
            forest.join(x, y if i == j else y + split)
        root = forest.roots(np.arange(len(found)))
        own = np.flatnonzero(root != np.arange(len(found)))
        # order by unsigned value has made roots the least; as longs, the smaller one is taken anew by the components
        return pd.DataFrame({"src": found[own].view(np.int64), "dst": found[root[own]].view(np.int64)})

    return values.mapInArrow(deal, "pair long, fingerprint long").groupBy("pair").applyInPandas(meet, "src long, dst long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (src, dst); root is the component's smallest node.

    Large and small stars by turns: each node's larger neighbours, then its smaller ones, are linked
    to the least of its neighbourhood. The number of rounds grows with the logarithm of the longest path.
    """
    links = stage_table(links.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    while True:
        both = links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("root"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("root").alias("dst"))
        large = stage_table(large.distinct())
        least = large.groupBy("src").agg(F.min("dst").alias("root"))
        small = large.join(least, "src").select(F.col("dst").alias("src"), F.col("root").alias("dst")).where("src != dst")
        small = stage_table(small.union(least.select("src", F.col("root").alias("dst"))).distinct())
        # stars only: no node is both a child and a root, and no child has two roots
        if small.select("src").intersect(small.select("dst")).isEmpty() and small.groupBy("src").count().where("count > 1").isEmpty():
            break
        links = small
    return small.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(small.select("dst", "dst").distinct())


def linked_values(marked: DataFrame, doc_id: str, fingerprint_: str, budget: int = MAX_DIFFERING) -> DataFrame:
    """fingerprint, root, component_id of every different fingerprint: root names the component, component_id is its smallest id.

    ``marked``: rows with their fingerprint, written before.
    """
    values = stage_table(marked.groupBy(F.col(f"`{fingerprint_}`").alias("fingerprint")).agg(F.min(doc_id).alias("least")))
    cells = plan_cells(values, values.count())
    linked = components(cell_links(values.select("fingerprint"), cells, budget))
    named = values.join(linked, values["fingerprint"] == linked["node"]).groupBy("root").agg(F.min("least").alias("component_id"))
    changed = linked.join(named, "root").select("node", "root", "component_id")
    return values.join(changed, values["fingerprint"] == changed["node"], "left").select(
        "fingerprint",
        F.coalesce("root", "fingerprint").alias("root"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, budget: int = MAX_DIFFERING) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id of all that are linked, one row per row of ``docs``."""
    marked = stage_table(docs.select(doc_id, fingerprint_of(text, words).alias("fingerprint")))
    return marked.join(linked_values(marked, doc_id, "fingerprint", budget), "fingerprint").select(
        doc_id, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, budget: int = MAX_DIFFERING) -> DataFrame:
    """``docs`` with one row of each component: one of those with the smallest id, a null id last.

    Ids and fingerprints decide; texts are shuffled once, to meet the pairs that go.
    """
    own, number = free_name("fingerprint", docs.columns), free_name("number", docs.columns)
    marked = stage_table(docs.withColumn(own, fingerprint_of(text, words)))
    root = linked_values(marked, doc_id, own, budget).select("fingerprint", "root")
    pairs = marked.groupBy(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{own}`").alias("fingerprint")).agg(F.count(F.lit(1)).alias("rows"))
    pairs = stage_table(pairs.join(root, "fingerprint"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "fingerprint")
    several = pairs.groupBy("root").agg(F.min(order).alias("first"), F.sum("rows").alias("all")).where("all > 1").select("root", "first")
    stays = F.expr("id <=> first.id and fingerprint = first.fingerprint")
    settled = stage_table(pairs.join(several, "root").select("id", "fingerprint", stays.alias("stays")).where("not stays"))
    tied = stage_table(pairs.join(several, "root").where(stays & (F.col("rows") > 1)).select("id", "fingerprint"))

    def of(keys: DataFrame) -> Column:
        return marked[doc_id].eqNullSafe(keys["id"]) & (marked[own] == keys["fingerprint"])

    # by sorting at every size: the plan must not change with what could be broadcast
    left = marked.join(settled.hint("merge"), of(settled), "left_anti")
    if tied.isEmpty():
        return left.select(docs.columns)
    place = F.row_number().over(Window.partitionBy(doc_id, own).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    single = left.join(tied.hint("merge"), of(tied), "left_anti").select(docs.columns)
    first = marked.join(tied.hint("merge"), of(tied), "left_semi").withColumn(number, place).where(F.col(number) == 1)
    return single.union(first.select(docs.columns))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return near_duplicates(table(spark, sf_dir, "documents"))
