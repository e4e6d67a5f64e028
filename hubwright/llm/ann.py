"""Approximate nearest neighbours over balanced posting lists.

1. Equal vectors become one row that carries its smallest few ids: no more of them can be among
   the answers. So a vector that a third of all rows hold weighs no more than another.
2. Centroids come from a bounded sample by balanced splitting: each cell is halved at the median
   along the line through two of its far points, until lists have about LIST_VECTORS vectors.
3. The centroids' nearest-neighbour graph is searched by best-first beams, in memory in each task. A vector
   goes into the list of its nearest centroid and, near a boundary, into those of others that are
   nearly as near.
4. A query probes the lists whose centroids are within a ratio of the nearest one's distance. Their number
   is capped by a share of all lists, so that it grows with the table, and the beam is as wide. Where vectors have no clusters, as
   Gaussian ones, the ratio leaves out hardly any list and the cap decides.
5. Lists that outgrow their share are split by a hash, and a query visits all parts. Scores are
   exact cosines of the original vectors in double precision.

Every row is indexed, and no list drops members. Defined results: vectors null, zero, with null or
non-finite components or without an id take no part, nor do those of another length than most; equal scores go
by the smaller id; with fewer than k candidates a query gets all it finds; an empty table gives an empty result.
Rows of one id count as one if their vectors are equal, else each is a candidate.
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

#: Vectors to a list on average, lists at most, and the sample's bounds in vectors to a list and numbers in all.
LIST_VECTORS, MOST_LISTS = 96, 1 << 14
SAMPLE_VECTORS, SAMPLE_NUMBERS = 16, 1 << 24
#: A list's part that one task compares at once.
PART_VECTORS = 4096
#: Links of a centroid, and centroids that a beam keeps.
LINKS, BEAM = 24, 48
#: A vector is copied to lists within this ratio of its nearest centroid's distance.
CLOSURE, MOST_COPIES = 1.12, 6
#: A query probes lists within this ratio, at least LEAST_PROBES and at most BEAM or this share of all, where that is more.
PROBE_RATIO, LEAST_PROBES, PROBE_SHARE = 1.5, 8, 0.125
SEED = 7


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids of cells of equal size, by repeated halving."""
    rng = np.random.default_rng(SEED)
    cells, total = [np.arange(len(sample))], max(1, min(lists, len(sample)))
    while len(cells) < total:
        cells.sort(key=len, reverse=True)
        if len(cells[0]) < 2:
            break
        take, halved = total - len(cells), []
        for cell in cells[:take]:
            if len(cell) < 2:
                halved.append(cell)
                continue
            points = sample[cell]
            # two far points give the direction
            far = points[np.argmin(points @ points[rng.integers(len(cell))])]
            other = points[np.argmin(points @ far)]
            order = np.argsort(points @ (far - other), kind="stable")
            halved += [cell[order[: len(cell) // 2]], cell[order[len(cell) // 2 :]]]
        cells = halved + cells[take:]
    means = np.stack([sample[c].mean(axis=0) for c in cells])
    size = np.linalg.norm(means, axis=1)
    # opposite vectors may cancel out: any member stands for such a cell
    means[size < 1e-9] = np.stack([sample[c[0]] for c in cells])[size < 1e-9]
    return unit(means).astype(np.float32)


@dataclass(frozen=True)
class CentroidGraph:
    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @staticmethod
    def build(centroids: np.ndarray, links: int = LINKS) -> CentroidGraph:
        """Nearest-neighbour links, and a few random ones so that the graph holds together."""
        n, rng = len(centroids), np.random.default_rng(SEED)
        near = min(links, n)
        found = np.empty((n, near), np.int32)
        for at in range(0, n, 1024):
            sims = centroids[at : at + 1024] @ centroids.T
            found[at : at + 1024] = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        far = rng.integers(0, n, (n, 4)).astype(np.int32)
        return CentroidGraph(centroids, np.concatenate([found, far], axis=1), rng.permutation(n)[: min(16, n)])

    def search(self, queries: np.ndarray, beam: int = BEAM, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the nearest centroids found for each unit query, nearest first."""
        parts = [self._beams(queries[at : at + batch], min(beam, len(self.centroids))) for at in range(0, len(queries), batch)]
        return np.concatenate([i for i, _ in parts]), np.concatenate([d for _, d in parts])

    def _beams(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        rows, n = np.arange(len(q))[:, None], len(self.centroids)
        ids = np.broadcast_to(self.entries, (len(q), len(self.entries))).copy()
        sims = q @ self.centroids[self.entries].T
        seen = np.zeros((len(q), n), bool)
        seen[:, self.entries] = True
        opened = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, opened = ids[rows, order], sims[rows, order], opened[rows, order]
            # the best that no beam has opened yet, more at once in a wide beam; -inf pads rows that are done
            waiting = np.where(opened, -np.inf, sims)
            pick = np.argsort(-waiting, axis=1, kind="stable")[:, : max(3, beam // 16)]
            live = np.isfinite(waiting[rows, pick])
            if not live.any():
                break
            opened[rows, pick] = True
            near = np.sort(np.where(live[:, :, None], self.links[ids[rows, pick]], -1).reshape(len(q), -1), axis=1)
            fresh = (near >= 0) & ~seen[rows, near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[rows, np.where(fresh, near, ids[:, :1])] = True
            found = np.where(fresh, np.einsum("bd,bnd->bn", q, self.centroids[near]), -np.inf)
            ids = np.concatenate([ids, near], axis=1)
            sims = np.concatenate([sims, found], axis=1)
            opened = np.concatenate([opened, ~fresh], axis=1)
        width = min(beam, ids.shape[1])
        return ids[:, :width], np.sqrt(np.maximum(0, 2 - 2 * sims[:, :width]))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id and vec: rows that take part."""
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where("id is not null and vec is not null").where(finite).where(F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (sizes["n"] if sizes else 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """vec, key (its smallest id) and ids, the ``keep`` smallest; copies are cut to those in each task, before the shuffle."""
    place = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.distinct().withColumn("place", place).where(F.col("place") <= keep)
    return few.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).select("vec", F.col("ids")[0].alias("key"), "ids")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def train(distinct: DataFrame, total: int, dims: int) -> CentroidGraph:
    lists = max(1, min(MOST_LISTS, total // LIST_VECTORS))
    wanted = max(1, min(SAMPLE_VECTORS * lists, SAMPLE_NUMBERS // dims))
    share = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 20)) < int(min(1.0, wanted / total) * (1 << 20)) + 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the driver gets bytes, not lists of numbers
        for batch in batches:
            made = unit(_matrix(batch.column(1))).astype("<f4") if batch.num_rows else np.empty((0, dims), "<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in made], pa.binary())], ["key", "numbers"])

    kind = distinct.schema["key"].dataType.simpleString()
    rows = sorted(distinct.where(share).select("key", "vec").mapInArrow(packed, f"key {kind}, numbers binary").collect())
    sample = np.frombuffer(b"".join(bytes(r["numbers"]) for r in rows), "<f4").reshape(len(rows), dims)
    return CentroidGraph.build(balanced_centroids(unit(sample.astype(np.float64)), lists))


def most_probes(lists: int) -> int:
    """Lists that a query probes at most."""
    return max(BEAM, math.ceil(PROBE_SHARE * lists))


def chosen_lists(vectors: np.ndarray, graph: CentroidGraph, ratio: float, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector its nearest lists, and which of them are taken."""
    lists, far = graph.search(vectors, max(BEAM, most))
    take = far <= ratio * far[:, :1] + 1e-6
    take[:, :least] = True
    take[:, most:] = False
    return lists, take


def place(rows: DataFrame, graph: CentroidGraph, ratio: float, least: int, most: int) -> DataFrame:
    """A row with ``list`` for each list that a vector goes into or a query probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, take = chosen_lists(unit(_matrix(batch.column(0))).astype(np.float32), graph, ratio, least, most)
            at, slot = np.nonzero(take)
            out = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(lists[at, slot].astype(np.int32))], [*out.schema.names, "list"])

    first = rows.select("vec", *[c for c in rows.columns if c != "vec"])
    return first.mapInArrow(run, first.schema.simpleString()[len("struct<") : -1] + ", list int")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every usable row of ``queries`` its k nearest rows of ``vectors`` but those of its own id."""
    rows = usable(vectors, vec_id, embedding)
    # a query's own id may be among the first k + 1
    distinct = stage_table(distinct_vectors(rows, k + 1))
    asked = usable(queries, vec_id, embedding)
    first = distinct.select(F.size("vec").alias("dims")).first()
    schema = f"query_id {rows.schema['id'].dataType.simpleString()}, rank int, vec_id {rows.schema['id'].dataType.simpleString()}, score double"
    if first is None:
        return vectors.sparkSession.createDataFrame([], schema)
    graph = train(distinct, distinct.count(), first["dims"])

    postings = stage_table(place(distinct, graph, CLOSURE, 1, MOST_COPIES))
    sizes = postings.groupBy("list").count().select("list", F.ceil(F.col("count") / PART_VECTORS).cast("int").alias("parts"))
    sizes = F.broadcast(stage_table(sizes))  # MOST_LISTS rows at most
    salt = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    postings = postings.join(sizes, "list").withColumn("part", salt).drop("parts")
    # queries of one vector are asked once, under a name that the vector gives: no window holds them all
    asked = stage_table(asked.withColumn("query", F.sha1(F.concat_ws(",", F.transform("vec", lambda x: (x + 0).cast("string"))))))
    probes = place(asked.groupBy("query").agg(F.first("vec").alias("vec")).select("vec", "query"), graph, PROBE_RATIO, LEAST_PROBES, most_probes(len(graph.centroids)))
    probes = probes.join(sizes, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def compare(members: pa.Table, probing: pa.Table) -> pa.Table:
        out_query, out_id, out_score = [], [], []
        if members.num_rows and probing.num_rows:
            a, q = _matrix(members.column("vec")), _matrix(probing.column("vec"))
            a_norm, q_norm = np.sqrt((a * a).sum(1)), np.sqrt((q * q).sum(1))
            ids, names = members.column("ids").to_pylist(), probing.column("query").to_pylist()
            width = min(k + 1, len(a))
            for at in range(0, len(q), 512):
                scores = (q[at : at + 512] @ a.T) / (q_norm[at : at + 512, None] * a_norm)
                # the last that can count, and all that tie with it
                floor = np.partition(scores, len(a) - width, axis=1)[:, len(a) - width]
                for row, (query, least) in enumerate(zip(names[at : at + 512], floor)):
                    near = np.flatnonzero(scores[row] >= least)
                    best = sorted((-scores[row, m], i) for m in near.tolist() for i in ids[m])[: k + 1]
                    out_query += [query] * len(best)
                    out_id += [i for _, i in best]
                    out_score += [-s for s, _ in best]
        kind = members.column("key").type
        return pa.table({"query": pa.array(out_query, pa.string()), "vec_id": pa.array(out_id, kind), "score": pa.array(out_score, pa.float64())})

    kind = rows.schema["id"].dataType.simpleString()
    found = postings.groupBy("list", "part").cogroup(probes.groupBy("list", "part")).applyInArrow(compare, f"query string, vec_id {kind}, score double")
    # a vector may have been met in several lists
    found = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.asc("vec_id")]
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= k + 1)
    answers = asked.select(F.col("id").alias("query_id"), "query").join(found.drop("place"), "query").where("vec_id != query_id")
    ranked = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_ann_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector, among all."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
