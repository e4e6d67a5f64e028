"""Graphs at rest: one Parquet table per label and edge pattern, by version.

Every save writes a new version next to the old ones and then appends its table
list to a log. That append is the switch: readers see the old version until it
is done, and a plan may read one version while it writes the next. To upsert,
save what ``upsert_nodes`` / ``upsert_edges`` make of the loaded graph.

Tables that come unchanged from a saved version keep their files; only the others are
written. Each save has a commit id: if two writers take the same number, readers see the one
with the smaller id, and the other one's save fails.
"""

from __future__ import annotations

import uuid
import weakref

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from hubwright.operators.graph import PropertyGraph

LOG = "versions"

#: Where loaded tables lie, for as long as their frames are in use.
_LOCATIONS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{LOG}")


def latest_version(spark: SparkSession, path: str) -> int:
    """Number of the newest complete version, 0 if there is none."""
    try:
        log = _read_log(spark, path)
    except AnalysisException:
        return 0
    return log.agg(F.max("version")).first()[0] or 0


def save_graph(graph: PropertyGraph, path: str) -> int:
    """Write the changed tables of a graph as a new version and return its number."""
    spark = next(iter(graph.nodes.values())).sparkSession
    version = latest_version(spark, path) + 1
    folder = f"{path}/data/{version}-{uuid.uuid4().hex[:8]}"
    commit = uuid.uuid4().hex

    def located(frame: DataFrame, name: str) -> str:
        known = _LOCATIONS.get(frame, "")
        if known.startswith(f"{path}/data/"):
            return known
        frame.write.parquet(f"{folder}/{name}")
        return f"{folder}/{name}"

    tables = [
        (version, commit, "node", label, None, None, located(frame, f"nodes-{i}"))
        for i, (label, frame) in enumerate(sorted(graph.nodes.items()))
    ]
    tables += [
        (version, commit, "edge", source, rel_type, target, located(frame, f"edges-{i}"))
        for i, ((source, rel_type, target), frame) in enumerate(sorted(graph.edges.items()))
    ]
    schema = "version bigint, commit string, kind string, label string, rel_type string, to_label string, location string"
    spark.createDataFrame(tables, schema).coalesce(1).write.mode("append").parquet(f"{path}/{LOG}")
    if _commit_of(_read_log(spark, path), version) != commit:
        raise RuntimeError(f"another save of {path} took version {version} first; load it and save again")
    return version


def _commit_of(log: DataFrame, version: int) -> str:
    return log.where(F.col("version") == version).agg(F.min("commit")).first()[0]


def load_saved_graph(spark: SparkSession, path: str, version: int | None = None) -> PropertyGraph:
    """A saved graph, by default its newest version. Reads the table list only; data is read when used."""
    wanted = latest_version(spark, path) if version is None else version
    log = _read_log(spark, path) if wanted else None
    tables = log.where((F.col("version") == wanted) & (F.col("commit") == _commit_of(log, wanted))).collect() if wanted else []
    if not tables:
        raise FileNotFoundError(f"no graph version {wanted} under {path}")
    graph = PropertyGraph()
    for row in tables:
        frame = spark.read.parquet(row["location"])
        _LOCATIONS[frame] = row["location"]
        if row["kind"] == "node":
            graph.nodes[row["label"]] = frame
        else:
            graph.edges[row["label"], row["rel_type"], row["to_label"]] = frame
    return graph
