"""Ranked lexical search with whole-number term weights, by posting lists cut into blocks of similar documents.

1. ``vectors``: each whole text becomes its length and the frequencies of the terms that any query has. Queries are taken in blocks of
   at most ``BLOCK_ITEMS`` items, so what a task is sent of them is bounded; documents are read once per block.
2. ``statistics`` and ``weights``: counts over all documents give each term's weight and each occurrence's impact.
3. ``starting_bounds``: a bounded sample of documents is searched first. The k-th best score in it is a proven lower bound of the
   k-th best of all, as the sampled documents are among them. It saves work and decides nothing else.
4. ``search_segment``: a task takes up to ``SEGMENT`` documents, inverts them, and goes through the posting lists from the rarest term
   on. A list is cut into blocks by document similarity: pivots are drawn from the list and each document joins the nearest, by the angle of
   projected impact vectors. A block's summary is the coordinatewise maximum of its documents' impacts; its
   product with a query bounds the score of every document in it. Blocks are visited by falling bound and skipped
   once the exact bound is below the query's k-th score. A query is done when the greatest impacts of its terms not yet gone through,
   each a summary of a whole list, add up to less than that score: a document not met by then has no other term.
5. Each segment's best k are merged to the best k of all.

All sums are whole numbers, and a block is skipped only if its bound is strictly lower, so results are exact, ties included.

Defined results: a null text has no terms; rows that repeat are documents of their own; equal scores go by id, a null id
last, then by the order of rows; items without a known term have no row, nor have items with a null text; items that share an id are
ranked together as one item with the terms of all; a very long text is one vector of the query terms it has; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hubwright.llm.common import table
from hubwright.session import stage_table

#: A-Z in lower case, all other ASCII characters but digits and letters as spaces; bytes beyond ASCII stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TOP = 10
#: Items searched in one pass over the documents, and the letters of their texts.
BLOCK_ITEMS, BLOCK_CHARS = 1 << 10, 1 << 20
#: Documents that a task indexes at once, and entries of their vectors; documents per block of a posting list.
SEGMENT, SEGMENT_ENTRIES, IN_BLOCK = 1 << 14, 1 << 22, 32
#: Documents searched first for starting bounds, about.
SAMPLE = 1 << 12
#: Dimensions onto which vectors are projected to compare documents.
DIMENSIONS = 16
SCALE = 1_000_000_000

FOUND = "item_id long, score long, doc_id long, row long"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Queries:
    """A block of items: their ids, the terms of all, and each item's terms by number."""

    items: list[int]
    vocabulary: dict[bytes, int]
    terms_of: list[np.ndarray]


def query_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Queries]:
    """The items in blocks, in order of their ids; the driver holds one block at a time."""
    own: dict[int, set[bytes]] = {}
    size = 0
    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(item_id, text).orderBy(item_id)
    for item, words in rows.toLocalIterator():
        if item not in own and own and (len(own) >= BLOCK_ITEMS or size + len(words) > BLOCK_CHARS):
            yield _block(own)
            own, size = {}, 0
        own.setdefault(item, set()).update(terms(words.encode()))
        size += len(words)
    if own:
        yield _block(own)


def _block(own: dict[int, set[bytes]]) -> Queries:
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*own.values())))}
    return Queries(list(own), vocabulary, [np.array(sorted(vocabulary[t] for t in ts), np.int64) for ts in own.values()])


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row, n, terms, tfs of every document with a term: its length and how often it has each term of ``vocabulary``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            kept, lengths, ends, numbers, tfs = [], [], [0], [], []
            for i, value in enumerate(batch.column(2)):
                words = terms(value.as_py())
                if not words:
                    continue
                known = np.fromiter((t for t in map(get, words) if t is not None), np.int32)
                number, tf = np.unique(known, return_counts=True)
                kept.append(i)
                lengths.append(len(words))
                numbers.append(number)
                tfs.append(tf.astype(np.int32))
                ends.append(ends[-1] + len(number))
            picked = batch.select([0, 1]).take(pa.array(kept, pa.int64()))
            flat = [pa.array(np.concatenate(x)) if x else pa.array([], pa.int32()) for x in (numbers, tfs)]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in flat]
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(lengths, pa.int64()), *lists], ["doc_id", "row", "n", "terms", "tfs"])

    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("binary").alias("text")
    )
    return rows.mapInArrow(make, "doc_id long, row long, n long, terms array<int>, tfs array<int>")


def statistics(made: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents, their length together, and documents per term of the block: a bounded number of counts."""
    row = made.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    counts = made.select(F.explode("terms").alias("term")).groupBy("term").count()
    return row["documents"], row["length"] or 0, {r["term"]: r["count"] for r in counts.collect()}


def weights(documents: int, frequency: dict[int, int], size: int) -> np.ndarray:
    """Each term's weight; terms that no document has weigh nothing."""
    out = np.zeros(size, np.int64)
    for term, df in frequency.items():
        out[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    return out


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = 10 + (90 * n * documents) // length
    return weight * ((SCALE * tf) // (1000 * tf + 8 * m))


class Search:
    """The best k of all items of a block so far, over documents fed to it segment by segment."""

    def __init__(self, queries: Queries, weight: np.ndarray, documents: int, length: int, bounds: np.ndarray, k: int):
        self.queries, self.weight, self.documents, self.length, self.k = queries, weight, documents, length, k
        self.projection = np.random.default_rng(11).choice(np.array([-1.0, 1.0], np.float32), (len(weight), DIMENSIONS))
        #: A document with a lower score cannot be among an item's best k.
        self.bounds = bounds.copy()
        self.best: list[list[tuple]] = [[] for _ in queries.items]
        self.items_of = [[] for _ in range(len(weight))]
        for item, own in enumerate(queries.terms_of):
            for t in own.tolist():
                self.items_of[t].append(item)

    def segment(self, ids: list, rows: list, n: np.ndarray, ends: np.ndarray, terms_: np.ndarray, tfs: np.ndarray) -> None:
        """Search documents given as their vectors; entries ``ends[i]`` to ``ends[i + 1]`` are document i's."""
        sizes = np.diff(ends)
        of = np.repeat(np.arange(len(ids)), sizes)
        value = impacts(self.weight[terms_], tfs.astype(np.int64), n[of], self.documents, self.length)
        order = np.lexsort((of, terms_))
        held, first = np.unique(terms_[order], return_index=True)
        ends_of = dict(zip(held.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)])))
        greatest = dict(zip(held.tolist(), np.maximum.reduceat(value[order], first).tolist())) if len(order) else {}
        # an entry for each item: what its terms not yet gone through can still add
        rest = [sum(greatest.get(t, 0) for t in own.tolist()) for own in self.queries.terms_of]
        seen = {}
        place = None
        for t in sorted(held.tolist(), key=lambda t: (ends_of[t][1] - ends_of[t][0], t)):
            active = [q for q in self.items_of[t] if rest[q] > 0 and rest[q] >= self.bounds[q]]
            if active and greatest[t] > 0:
                if place is None:
                    place = self._places(len(ids), of, terms_, value)
                a, b = ends_of[t]
                blocks, starts = cut_list(of[order[a:b]], place, t)
                summary, columns = self._summaries(blocks, starts, active, ends, terms_, value)
                for q in active:
                    bound = summary[:, columns[self.queries.terms_of[q]]].sum(axis=1)
                    done = seen.setdefault(q, np.zeros(len(ids), bool))
                    self._visit(q, bound, blocks, starts, done, ids, rows, ends, terms_, value)
            for q in self.items_of[t]:
                rest[q] -= greatest[t]

    def _places(self, documents: int, of: np.ndarray, terms_: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Each document's projected impact vector, of length one."""
        place = np.zeros((documents, DIMENSIONS), np.float32)
        for d in range(DIMENSIONS):
            place[:, d] = np.bincount(of, self.projection[terms_, d] * value, documents)
        return place / np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-9)

    def _summaries(self, blocks: np.ndarray, starts: np.ndarray, active: list[int], ends: np.ndarray, terms_: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per block the coordinatewise maximum, in the coordinates that an active item asks for; and each term's column."""
        asked = np.unique(np.concatenate([self.queries.terms_of[q] for q in active]))
        columns = np.full(len(self.weight), -1)
        columns[asked] = np.arange(len(asked))
        at, lengths = entries(blocks, ends)
        block = np.repeat(np.repeat(np.arange(len(starts)), np.diff([*starts.tolist(), len(blocks)])), lengths)
        column = columns[terms_[at]]
        known = column >= 0
        summary = np.zeros((len(starts), len(asked)), np.int64)
        np.maximum.at(summary, (block[known], column[known]), value[at[known]])
        return summary, columns

    def _visit(self, q, bound, blocks, starts, done, ids, rows, ends, terms_, value) -> None:
        order = np.argsort(-bound, kind="stable")
        limits = np.append(starts, len(blocks))
        asked = np.zeros(len(self.weight), bool)
        asked[self.queries.terms_of[q]] = True
        at, step = 0, 4
        while at < len(order):
            part = order[at : at + step]
            part = part[(bound[part] >= self.bounds[q]) & (bound[part] > 0)]
            if not len(part):
                break
            members = np.concatenate([blocks[limits[b] : limits[b + 1]] for b in part.tolist()])
            members = members[~done[members]]
            if len(members):
                done[members] = True
                found, lengths = entries(members, ends)
                scores = np.add.reduceat(np.where(asked[terms_[found]], value[found], 0), np.cumsum(lengths) - lengths)
                good = np.flatnonzero((scores >= self.bounds[q]) & (scores > 0))
                self._offer(q, [(-int(scores[i]), ids[members[i]] is None, ids[members[i]] or 0, rows[members[i]]) for i in good.tolist()])
            at, step = at + step, 2 * step

    def _offer(self, q: int, found: list[tuple]) -> None:
        if not found:
            return
        best = self.best[q] = sorted(self.best[q] + found)[: self.k]
        if len(best) == self.k:
            self.bounds[q] = max(self.bounds[q], -best[-1][0])

    def result(self) -> pa.RecordBatch:
        flat = [(item, -s, None if no_id else d, row) for item, best in zip(self.queries.items, self.best) for s, no_id, d, row in best]
        columns = list(zip(*flat)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "score", "doc_id", "row"])


def entries(documents: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the documents, one document after the other, and how many each has."""
    lengths = ends[documents + 1] - ends[documents]
    shift = np.repeat(ends[documents] - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(int(lengths.sum())) + shift, lengths


def cut_list(members: np.ndarray, place: np.ndarray, seed: int, in_block: int = IN_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """A posting list's documents, block by block, and where each block starts. Blocks hold documents near one pivot, ``in_block`` at most."""
    pivots = -(-len(members) // in_block)
    if pivots == 1:
        return members, np.zeros(1, np.int64)
    drawn = np.random.default_rng(seed).choice(members, pivots, replace=False)
    nearest = np.concatenate([np.argmax(place[members[i : i + 4096]] @ place[drawn].T, axis=1) for i in range(0, len(members), 4096)])
    order = np.argsort(nearest, kind="stable")
    blocks, near = members[order], nearest[order]
    # copies all join one pivot: a cluster is cut into blocks of equal size
    first = np.flatnonzero(np.append(True, near[1:] != near[:-1]))
    within = np.arange(len(near)) - np.repeat(first, np.diff(np.append(first, len(near))))
    return blocks, np.flatnonzero(within % in_block == 0)


def search_segments(made: DataFrame, queries: Queries, weight: np.ndarray, documents: int, length: int, bounds: np.ndarray, k: int = TOP) -> DataFrame:
    """Each task's best k documents per item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(queries, weight, documents, length, bounds, k)
        for part in segments(batches):
            search.segment(*part)
        yield search.result()

    return made.mapInArrow(run, FOUND)


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Documents in lots of at most ``SEGMENT`` rows and, but for a single document, ``SEGMENT_ENTRIES`` entries."""
    lot, rows, size = [], 0, 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            offsets = batch.column(3).offsets.to_numpy()
            fit = int(np.searchsorted(offsets, offsets[at] + SEGMENT_ENTRIES - size, side="right")) - 1 - at
            take = min(batch.num_rows - at, SEGMENT - rows, max(fit, 0 if rows else 1))
            if take > 0:
                part = batch.slice(at, take)
                lot.append(part)
                rows, size, at = rows + take, size + int(offsets[at + take] - offsets[at]), at + take
            if take <= 0 or rows >= SEGMENT or size >= SEGMENT_ENTRIES:
                yield _flat(lot)
                lot, rows, size = [], 0, 0
    if lot:
        yield _flat(lot)


def _flat(lot: list[pa.RecordBatch]) -> tuple:
    whole = pa.Table.from_batches(lot).combine_chunks()
    lists = [whole.column(c).combine_chunks() for c in ("terms", "tfs")]
    lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
    lengths = lists[0].value_lengths().to_numpy()
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = [x.flatten().to_numpy() for x in lists]
    return whole.column("doc_id").to_pylist(), whole.column("row").to_pylist(), whole.column("n").to_numpy(), ends, flat[0].astype(np.int64), flat[1]


def best_of(found: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the best k per item; Spark keeps k rows per item and task before it shuffles."""
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def starting_bounds(made: DataFrame, queries: Queries, weight: np.ndarray, documents: int, length: int, k: int = TOP) -> np.ndarray:
    """A score per item that its k-th best document has at least: the k-th best of about ``SAMPLE`` documents."""
    bounds = np.zeros(len(queries.items), np.int64)
    one_in = max(1, documents // SAMPLE)
    sample = made.where(F.pmod(F.xxhash64("row"), F.lit(one_in)) == 0)
    last = best_of(search_segments(sample, queries, weight, documents, length, bounds, k), k).where(F.col("rank") == k)
    number = {item: i for i, item in enumerate(queries.items)}
    for r in last.collect():
        bounds[number[r["item_id"]]] = r["score"]
    return bounds


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents."""
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for queries in query_blocks(items, item_id, item_text):
        made = stage_table(vectors(docs, queries.vocabulary, doc_id, text))
        documents, length, frequency = statistics(made)
        if not frequency:
            continue
        weight = weights(documents, frequency, len(queries.vocabulary))
        bounds = starting_bounds(made, queries, weight, documents, length, k)
        found = best_of(search_segments(made, queries, weight, documents, length, bounds, k), k)
        out = out.union(stage_table(found))
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM documents
), l AS (
  SELECT doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0
), s AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM l
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM benchmark
), p AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM l) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs
), r AS (
  SELECT q.item_id, p.doc_id,
    CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + ((90 * p.n * s.docs) // s.total))))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY q.item_id, p.doc_id
), o AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
