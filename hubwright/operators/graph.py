"""A property graph as DataFrames: one per label, one per (from, type, to)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

EdgeKey = tuple[str, str, str]

ID = "_id"
KEY = "_key"
SRC = "src_id"
DST = "dst_id"
NODE_META = (ID, KEY)
EDGE_ENDS = (SRC, DST)


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """Stack frames whose columns may differ; numbers widen, other type clashes are errors."""
    frames = list(frames)
    seen: dict[str, T.DataType] = {}
    for frame in frames:
        for f in frame.schema.fields:
            known = seen.setdefault(f.name, f.dataType)
            numeric = isinstance(known, T.NumericType) and isinstance(f.dataType, T.NumericType)
            if known != f.dataType and not numeric:
                raise TypeError(f"column {f.name} is {known.simpleString()} in one load and {f.dataType.simpleString()} in another")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@dataclass
class PropertyGraph:
    """Node frames carry ``_id``, ``_key`` and properties; edge frames ``src_id``, ``dst_id`` and properties.

    ``_id`` holds key name and value (``id=7``, ``value=shipped``), so a hub and
    an entity of one label never mix. ``_key`` names the key property.
    """

    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[EdgeKey, DataFrame] = field(default_factory=dict)

    def node(self, label: str) -> DataFrame:
        if label not in self.nodes:
            raise KeyError(f"no label {label}; there are {', '.join(sorted(self.nodes)) or 'none'}")
        return self.nodes[label]

    def edge_keys(self, rel_type: str | None = None, from_label: str | None = None, to_label: str | None = None) -> list[EdgeKey]:
        """Edge tables that fit, for unknown names an error instead of an empty answer."""
        found = [
            key
            for key in sorted(self.edges)
            if rel_type in (None, key[1]) and from_label in (None, key[0]) and to_label in (None, key[2])
        ]
        if not found:
            raise KeyError(f"no edges ({from_label or '*'})-[{rel_type or '*'}]->({to_label or '*'})")
        return found

    def edge(self, rel_type: str, from_label: str | None = None, to_label: str | None = None) -> DataFrame:
        """The edges of one pattern. A type that several pairs of labels share needs the labels, as an id is unique within its label only."""
        keys = self.edge_keys(rel_type, from_label, to_label)
        if len(keys) > 1:
            found = ", ".join(f"({a})-[{t}]->({b})" for a, t, b in keys)
            raise ValueError(f"{rel_type} is ambiguous, name its labels: {found}")
        return self.edges[keys[0]]

    def all_nodes(self) -> DataFrame:
        return reduce(
            DataFrame.unionByName,
            [self.nodes[label].select(F.lit(label).alias("label"), ID) for label in sorted(self.nodes)],
        )

    def all_edges(self, keys: Iterable[EdgeKey] | None = None) -> DataFrame:
        keys = sorted(self.edges) if keys is None else list(keys)
        if not keys:
            spark = next(iter(self.nodes.values())).sparkSession
            return spark.createDataFrame([], "from_label string, src_id string, type string, to_label string, dst_id string")
        return reduce(
            DataFrame.unionByName,
            [
                self.edges[key].select(
                    F.lit(key[0]).alias("from_label"),
                    SRC,
                    F.lit(key[1]).alias("type"),
                    F.lit(key[2]).alias("to_label"),
                    DST,
                )
                for key in keys
            ],
        )

    def with_nodes(self, label: str, frame: DataFrame) -> PropertyGraph:
        return PropertyGraph({**self.nodes, label: frame}, dict(self.edges))

    def with_edges(self, key: EdgeKey, frame: DataFrame) -> PropertyGraph:
        return PropertyGraph(dict(self.nodes), {**self.edges, key: frame})

    def map_frames(self, change: Callable[[DataFrame], DataFrame]) -> PropertyGraph:
        """Apply the same step, such as a lineage cut, to every table."""
        return PropertyGraph(
            {k: change(v) for k, v in self.nodes.items()},
            {k: change(v) for k, v in self.edges.items()},
        )


def property_names(frame: DataFrame, meta: tuple[str, ...] = NODE_META) -> list[str]:
    return [c for c in frame.columns if c not in meta]


def property_schema(frame: DataFrame, meta: tuple[str, ...] = NODE_META) -> T.StructType:
    return T.StructType([f for f in frame.schema.fields if f.name not in meta])
