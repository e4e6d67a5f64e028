"""A graph store that merges on read: an upsert writes what arrived and nothing else.

Each table is dealt into hash buckets of its key. A load writes base files, one folder per version with a
sub-folder per bucket; an upsert adds delta files to the buckets its rows fall into, without reading what is
there. A log, appended once per version, names the folders a version adds to each bucket. It is the manifest, and its
append is the commit. Readers take buckets without deltas as they are, and merge the others by key:

* of nodes, the newest value of each column that a delta carries wins, NULL included; columns it does not carry stay,
  so key-only nodes and hubs never clear what is known;
* of edges likewise, by both ends. Where rows are loaded again (``replace_for_upserted``), their nodes are written
  as voided sources; older edges of those sources no longer count.

``compact`` rewrites the buckets whose deltas have outgrown a share of their base, and leaves the files of all others.
A version may carry the name of a batch, by which a repeated batch is known, and the high-water mark that belongs to it.

Edges made of a table's rows are dealt by their source, of which each has few; edges of link tables by both ends, as a
source of theirs may be hot. The number of buckets is set when a table is first written, and anew when it has outgrown them;
``bucket_rows`` below ``BUCKET_ROWS`` holds for tables of few buckets (``session.bucket_count``), so files do not grow with the rows.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from hubwright.operators.build import build_graph
from hubwright.operators.graph import DST, EDGE_ENDS, ID, SRC, EdgeKey, PropertyGraph, union_by_name
from hubwright.plans.model import JoinModel, Model
from hubwright.session import bucket_count, delete_folder, scratch, stage_table
from hubwright.sources.tables import TableSpec

#: Rows a bucket is planned for when its table is first written.
BUCKET_ROWS = 1 << 20
#: A bucket is compacted once its deltas have that share of its base's rows, or are so many.
DELTA_SHARE, MOST_DELTAS = 0.25, 8

LOG = "manifest"
LOG_SCHEMA = (
    "version bigint, commit string, batch string, mark string, name array<string>, kind string, "
    "bucket int, rows bigint, buckets int, dealt_by array<string>, folder string, columns string"
)
BASE, DELTA, VOID, COMMIT = "base", "delta", "void", "commit"
BUCKET, _SEQ, _CARRIED, _VOIDED = "_bucket", "_seq", "_carried", "_voided"

#: A label, or the three names of an edge pattern.
Name = tuple[str, ...]


@dataclass(frozen=True)
class Folder:
    """What one write added to a table."""

    version: int
    kind: str
    path: str
    schema: T.StructType


@dataclass
class StoredTable:
    """The buckets of a table at one version: per bucket its newest base, then what came after it, with their rows."""

    name: Name
    buckets: int
    dealt_by: list[str]
    live: dict[int, dict[Folder, int]] = field(default_factory=lambda: defaultdict(dict))
    schemas: list[T.StructType] = field(default_factory=list)

    @property
    def keys(self) -> list[str]:
        return [ID] if len(self.name) == 1 else list(EDGE_ENDS)

    def overgrown(self, share: float, most: int) -> list[int]:
        """Buckets to compact."""
        found = []
        for bucket, parts in self.live.items():
            base = sum(n for f, n in parts.items() if f.kind == BASE)
            added = [n for f, n in parts.items() if f.kind != BASE]
            if added and (sum(added) >= share * base or len(added) >= most):
                found.append(bucket)
        return found


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(f"{path}/{LOG}")
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], LOG_SCHEMA)


def _heads(spark: SparkSession, path: str) -> dict[int, Row]:
    """version, commit, batch and mark of every version: of two writers of one number, the one with the smaller commit."""
    own = _log(spark, path).where(F.col("kind") == COMMIT).select("version", "commit", "batch", "mark")
    return {r["version"]: r for r in sorted(own.collect(), key=lambda r: r["commit"], reverse=True)}


def newest_version(spark: SparkSession, path: str) -> int:
    """Number of the newest version, 0 if there is none."""
    return max(_heads(spark, path), default=0)


def stored_mark(spark: SparkSession, path: str) -> str | None:
    """The high-water mark that the newest version with one was committed with."""
    marks = {v: head["mark"] for v, head in _heads(spark, path).items() if head["mark"] is not None}
    return marks[max(marks)] if marks else None


def stored_tables(spark: SparkSession, path: str, version: int | None = None) -> list[StoredTable]:
    """The manifest of a version: one entry per bucket and folder, no row of the graph."""
    return _tables_at(spark, path, _heads(spark, path), version)


def _tables_at(spark: SparkSession, path: str, heads: dict[int, Row], version: int | None = None) -> list[StoredTable]:
    log = _log(spark, path).where((F.col("kind") != COMMIT) & (F.col("version") <= (max(heads, default=0) if version is None else version)))
    tables: dict[Name, StoredTable] = {}
    for r in sorted(log.collect(), key=lambda r: (r["version"], r["folder"])):
        if r["commit"] != heads[r["version"]]["commit"]:
            continue
        name = tuple(r["name"])
        table = tables.setdefault(name, StoredTable(name, r["buckets"], list(r["dealt_by"])))
        folder = Folder(r["version"], r["kind"], f"{path}/{r['folder']}", T.StructType.fromJson(json.loads(r["columns"])))
        if r["buckets"] != table.buckets:  # dealt anew: what lay in the old buckets is superseded
            table.buckets = r["buckets"]
            table.live.clear()
        if folder.kind != VOID and folder.schema not in table.schemas:
            table.schemas.append(folder.schema)
        if r["bucket"] is not None:
            if folder.kind == BASE:
                table.live[r["bucket"]] = {}
            table.live[r["bucket"]][folder] = r["rows"]
    return list(tables.values())


class _Version:
    """The folders of one version, committed together."""

    def __init__(self, spark: SparkSession, path: str, newest: int, batch: str | None = None, mark: str | None = None):
        self.spark, self.path = spark, path
        self.head = (newest + 1, uuid.uuid4().hex, batch, mark)
        self.writes: list[tuple[StoredTable, Folder, list[int]]] = []

    def write(self, table: StoredTable, kind: str, frame: DataFrame, buckets: Iterable[int] = ()) -> None:
        """Write rows into their buckets, each bucket by one task; ``buckets`` are noted even if they get none."""
        folder = Folder(self.head[0], kind, f"data/{self.head[0]}-{uuid.uuid4().hex[:12]}", frame.schema)
        dealt = frame.withColumn(BUCKET, F.pmod(F.xxhash64(*table.dealt_by), F.lit(table.buckets)).cast("int"))
        sorted_ = dealt.repartition(BUCKET).sortWithinPartitions(BUCKET, *table.dealt_by)
        sorted_.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder.path}")
        self.writes.append((table, folder, list(buckets)))

    def _entries(self) -> list[tuple]:
        """What was written, counted from the new files alone, all folders in one job."""
        counts = [
            _read(self.spark, replace(folder, path=f"{self.path}/{folder.path}")).groupBy(BUCKET).count().select(F.lit(i).alias("write"), BUCKET, "count")
            for i, (_, folder, _) in enumerate(self.writes)
        ]
        rows = [dict.fromkeys(noted, 0) for _, _, noted in self.writes]
        for r in reduce(DataFrame.unionByName, counts).collect():
            rows[r["write"]][r[BUCKET]] = r["count"]
        return [
            (*self.head, list(table.name), folder.kind, bucket, n, table.buckets, table.dealt_by, folder.path, folder.schema.json())
            for (table, folder, _), found in zip(self.writes, rows)
            for bucket, n in (found or {None: 0}).items()  # a table without rows is noted too
        ]

    def commit(self) -> int:
        rows = [(*self.head, None, COMMIT, *[None] * 6), *self._entries()]
        self.spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/{LOG}")
        version, own = self.head[:2]
        if _heads(self.spark, self.path)[version]["commit"] != own:
            raise RuntimeError(f"another writer of {self.path} took version {version} first; try again")
        return version


def _read(spark: SparkSession, folder: Folder) -> DataFrame:
    return spark.read.schema(T.StructType([*folder.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(folder.path)


def _frames(graph: PropertyGraph) -> list[tuple[Name, DataFrame]]:
    return [((label,), f) for label, f in sorted(graph.nodes.items())] + sorted(graph.edges.items(), key=lambda e: e[0])


def _new_table(name: Name, rows: int, by_source: bool, bucket_rows: int) -> StoredTable:
    dealt_by = [ID] if len(name) == 1 else [SRC] if by_source else list(EDGE_ENDS)
    return StoredTable(name, bucket_count(rows, bucket_rows, BUCKET_ROWS), dealt_by)


def create(graph: PropertyGraph, path: str, models: Iterable[Model] = (), bucket_rows: int = BUCKET_ROWS) -> int:
    """Write a graph as a new store. Edges of ``models`` that are made of rows are dealt by source, so that upserts may replace them."""
    spark = next(iter(graph.nodes.values())).sparkSession
    if newest_version(spark, path):
        raise FileExistsError(f"there is a store under {path}")
    by_source = {(m.label, r.rel_type, r.to_label) for m in models if not isinstance(m, JoinModel) for r in m.relationships}
    version = _Version(spark, path, 0)
    for name, frame in _frames(graph):
        version.write(_new_table(name, frame.count(), name in by_source, bucket_rows), BASE, frame)
    return version.commit()


def upsert(
    spark: SparkSession, path: str, spec: TableSpec, model: Model, replace_for_upserted: bool = True,
    batch: str | None = None, mark: str | None = None, bucket_rows: int = BUCKET_ROWS,
) -> int:
    """Add the rows of ``spec`` to the store as deltas: writes those rows and reads none of the store's.

    A batch that was committed before is not written again.
    """
    heads = _heads(spark, path)
    known = [head["version"] for head in heads.values() if batch is not None and head["batch"] == batch]
    if known:
        return known[0]
    tables = {t.name: t for t in _tables_at(spark, path, heads)}
    by_source = not isinstance(model, JoinModel)
    version = _Version(spark, path, max(heads, default=0), batch, mark)
    with scratch(spark):
        spec = replace(spec, df=stage_table(spec.df))
        fresh = build_graph([(spec, model)])
        frames = dict(_frames(fresh))
        loaded = build_graph([(spec, replace(model, relationships=()))]).nodes[model.label].select(ID) if by_source else None
        for name, frame in frames.items():
            table = tables.get(name) or _new_table(name, frame.count(), by_source, bucket_rows)
            if len(name) == 3 and by_source and replace_for_upserted and name in tables:
                if table.dealt_by != [SRC]:
                    raise ValueError(f"{name} is dealt by both ends; create the store with its model to replace edges of a source")
                version.write(table, VOID, loaded.select(F.col(ID).alias(SRC)))
            version.write(table, DELTA, frame)
        return version.commit()


def _select(spark: SparkSession, table: StoredTable, buckets: Iterable[int]) -> dict[Folder, DataFrame]:
    """Of each folder that is live in one of the buckets, the rows of those; a partition filter, so only their files are listed."""
    wanted: dict[Folder, list[int]] = defaultdict(list)
    for bucket in buckets:
        for folder in table.live[bucket]:
            wanted[folder].append(bucket)
    return {folder: _read(spark, folder).where(F.col(BUCKET).isin(found)).drop(BUCKET) for folder, found in wanted.items()}


def _newest(column: str, all_carry: bool) -> Column:
    by = F.col(_SEQ) if all_carry else F.when(F.array_contains(_CARRIED, column), F.col(_SEQ))
    return F.max_by(F.col(f"`{column}`"), by).alias(column)


def _merged(spark: SparkSession, table: StoredTable, buckets: Iterable[int]) -> DataFrame:
    """The rows of the buckets, base and deltas merged by key: one shuffle, of these buckets alone."""
    parts, voids, schemas = [], [], []
    for folder, frame in _select(spark, table, buckets).items():
        frame = frame.withColumn(_SEQ, F.lit(folder.version).cast("long"))
        if folder.kind == VOID:
            voids.append(frame)
        else:
            schemas.append(set(folder.schema.names))
            parts.append(frame.withColumn(_CARRIED, F.array(*[F.lit(c) for c in folder.schema.names])))
    if not parts:
        return spark.createDataFrame([], table.schemas[0])
    rows = union_by_name(parts)
    if voids:
        last = union_by_name(voids).groupBy(SRC).agg(F.max(_SEQ).alias(_VOIDED))
        rows = rows.join(last, SRC, "left").where(F.col(_VOIDED).isNull() | (F.col(_SEQ) >= F.col(_VOIDED)))
    rest = [c for c in rows.columns if c not in (*table.keys, _SEQ, _CARRIED, _VOIDED)]
    if not rest:
        return rows.select(*table.keys).distinct()
    return rows.groupBy(*table.keys).agg(*[_newest(c, all(c in s for s in schemas)) for c in rest])


def _table_frame(spark: SparkSession, table: StoredTable) -> DataFrame:
    plain = [b for b, parts in table.live.items() if len(parts) == 1 and next(iter(parts)).kind == BASE]
    touched = sorted(set(table.live) - set(plain))
    frames = list(_select(spark, table, plain).values())
    if touched:
        frames.append(_merged(spark, table, touched))
    frame = union_by_name(frames) if frames else spark.createDataFrame([], table.schemas[0])
    # a table's columns do not depend on which buckets hold rows
    for f in {f.name: f for schema in table.schemas for f in schema.fields if f.name not in frame.columns}.values():
        frame = frame.withColumn(f.name, F.lit(None).cast(f.dataType))
    return frame


def load(spark: SparkSession, path: str, version: int | None = None) -> PropertyGraph:
    """The graph at a version, by default the newest. Reads the manifest only; data is read when used."""
    tables = stored_tables(spark, path, version)
    if not tables:
        raise FileNotFoundError(f"no graph under {path}")
    graph = PropertyGraph()
    for table in tables:
        if len(table.name) == 1:
            graph.nodes[table.name[0]] = _table_frame(spark, table)
        else:
            graph.edges[table.name] = _table_frame(spark, table)
    return graph


def compact(spark: SparkSession, path: str, share: float = DELTA_SHARE, most: int = MOST_DELTAS, bucket_rows: int = BUCKET_ROWS) -> int | None:
    """Rewrite overgrown buckets as new bases; the number of the version, or None if there was nothing to do.

    A table that has grown to twice the rows its buckets are planned for is dealt into more buckets as a whole; as that
    happens once per doubling, a row is rewritten so a bounded number of times on average.
    """
    heads = _heads(spark, path)
    version = _Version(spark, path, max(heads, default=0))
    for table in _tables_at(spark, path, heads):
        rows = sum(n for parts in table.live.values() for folder, n in parts.items() if folder.kind != VOID)
        wanted = bucket_count(rows, bucket_rows, BUCKET_ROWS)
        if wanted > 2 * table.buckets:
            version.write(StoredTable(table.name, wanted, table.dealt_by), BASE, _table_frame(spark, table))
            continue
        buckets = table.overgrown(share, most)
        if buckets:
            version.write(table, BASE, _merged(spark, table, buckets), buckets)
    return version.commit() if version.writes else None


def live_files(spark: SparkSession, path: str, version: int | None = None) -> list[tuple[Name, int, str, str, int]]:
    """(table, bucket, kind, folder, rows) of everything a reader of the version opens."""
    return [
        (table.name, bucket, folder.kind, f"{folder.path}/{BUCKET}={bucket}", rows)
        for table in stored_tables(spark, path, version) for bucket, parts in sorted(table.live.items()) for folder, rows in parts.items()
    ]


def vacuum(spark: SparkSession, path: str, version: int) -> int:
    """Delete the bucket folders that no reader of ``version`` or a later one opens; returns how many went."""
    newest = newest_version(spark, path)
    # a folder that a later version needs is either needed now or written after now
    needed = {f for _, _, _, f, _ in live_files(spark, path, version)}
    written = {f for v in range(1, min(version, newest + 1)) for _, _, _, f, _ in live_files(spark, path, v)}
    return sum(delete_folder(spark, folder) for folder in sorted(written - needed))
