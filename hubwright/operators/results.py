"""Results a person reads: bounded, flat, nested graph values spelled out."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, functions as F

from hubwright.functions.values import property_entries
from hubwright.operators.graph import DST, EDGE_ENDS, ID, SRC, property_schema

DEFAULT_ROWS = 200
MOST_ROWS = 1000


@dataclass(frozen=True)
class Result:
    columns: list[str]
    rows: list[Row]
    truncated: bool
    elapsed_ms: int

    @property
    def row_count(self) -> int:
        return len(self.rows)


def bounded_rows(n: int) -> int:
    if not 1 <= n <= MOST_ROWS:
        raise ValueError(f"a result holds 1 to {MOST_ROWS} rows, not {n}")
    return n


def bounded(df: DataFrame, n: int = DEFAULT_ROWS) -> Result:
    """At most n rows (1 to 1000) on the driver, and whether there were more."""
    n = bounded_rows(n)
    started = time.monotonic()
    rows = df.limit(n + 1).collect()
    return Result(df.columns, rows[:n], len(rows) > n, round((time.monotonic() - started) * 1000))


def _properties(frame: DataFrame, meta: tuple[str, ...]):
    return F.map_from_entries(property_entries(property_schema(frame, meta)))


def nodes_as_result(frame: DataFrame, label: str) -> DataFrame:
    """``{label, props}`` per node; absent properties are left out."""
    return frame.select(ID, F.struct(F.lit(label).alias("label"), _properties(frame, (ID, "_key")).alias("props")).alias("node"))


def edges_as_result(frame: DataFrame, rel_type: str) -> DataFrame:
    """``{type, props}`` per edge."""
    return frame.select(SRC, DST, F.struct(F.lit(rel_type).alias("type"), _properties(frame, EDGE_ENDS).alias("props")).alias("edge"))


def paths_as_result(paths: DataFrame) -> DataFrame:
    """Paths as one alternating list: node, type, node, ... as text."""
    node = lambda n: F.concat(n["label"], F.lit(":"), n["id"])
    tail = F.zip_with("types", F.slice("nodes", F.lit(2), F.size("types")), lambda t, n: F.array(t, node(n)))
    return paths.select(F.concat(F.array(node(F.col("nodes")[0])), F.flatten(tail)).alias("path"))


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row; nested values are flattened into it."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
