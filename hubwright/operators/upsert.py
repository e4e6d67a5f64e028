"""Merging new nodes and edges into a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hubwright.operators.graph import EDGE_ENDS, ID, SRC, union_by_name


def _merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key. Where both have it, columns the new frame carries win, NULLs included.

    Known rows are updated by a left join and unknown ones appended, which lets
    Spark broadcast the new rows if it measures them as small: a small delta
    then never shuffles the old table. Keys are unique on both sides, so no key is hot.
    """
    # a rename cuts the ties between frames read from one source
    fresh = new.select(*keys, *[F.col(f"`{c}`").alias(f"_new_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_arrived"))
    updated = old.join(fresh, keys, "left")
    arrived = F.col("_arrived").isNotNull()
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    merged = []
    for c in columns:
        if c in keys or c not in new.columns:
            merged.append(F.col(f"`{c}`"))
        elif c not in old.columns:
            merged.append(F.col(f"`_new_{c}`").alias(c))
        else:
            merged.append(F.when(arrived, F.col(f"`_new_{c}`")).otherwise(F.col(f"`{c}`")).alias(c))
    return updated.select(*merged).unionByName(_unknown(old, new, keys), allowMissingColumns=True)


def _unknown(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key is not there yet. The old side is cut down to the new keys first, on its key columns alone."""
    known = old.select(*keys).join(new.select(*keys), keys, "left_semi")
    return new.join(known, keys, "left_anti")


def insert_missing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add nodes that are not there yet and leave all others alone."""
    return union_by_name([old, _unknown(old, new, [ID])])


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New nodes are added, known ones get the new properties; a stub is filled in place."""
    return _merge(old, new, [ID])


def upsert_edges(old: DataFrame, new: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Edges of both by their ends, properties overwritten.

    ``touched`` holds the ``_id`` of the rows that were loaded again and that all
    new edges come from: what they linked to before is dropped. Without it an old
    edge stays beside the new one, as plain merging leaves it.
    """
    if touched is None:
        return _merge(old, new, list(EDGE_ENDS))
    kept = old.join(touched.select(F.col(ID).alias(SRC)), SRC, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
