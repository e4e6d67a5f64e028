"""First analyses that fit a model, by name, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from hubwright.operators.cooccurrence import co_occurrence
from hubwright.operators.graph import DST, ID, SRC, PropertyGraph
from hubwright.operators.match import busiest, count_per_target, paths_from, shared_neighbor_counts, sum_edge_property
from hubwright.operators.paths import shortest_path
from hubwright.plans.model import DIMENSION, FOREIGN_KEY, JoinModel, Model


PATH_HOPS = 6


def _first_two(graph: PropertyGraph, label: str, longest: int = PATH_HOPS) -> DataFrame:
    """A shortest path between the two smallest nodes of a label; its status tells whether it would be longer than ``longest``."""
    ids = [row[ID] for row in graph.node(label).select(ID).orderBy(ID).limit(2).collect()]
    if len(ids) < 2:
        raise ValueError(f"label {label} has fewer than two nodes")
    return shortest_path(graph, (label, ids[0]), (label, ids[1]), longest)


def starter_frames(graph: PropertyGraph, model: Model, k: int = 10) -> dict[str, Callable[[], DataFrame]]:
    """Analyses to begin with; each is called to get its DataFrame, as some need a job to be planned."""
    if isinstance(model, JoinModel):
        rel, ends = model.rel_type, {"from_label": model.from_label, "to_label": model.to_label}
        frames = {
            "busiest": lambda: busiest(graph, rel, k, **ends),
            "together": lambda: co_occurrence(graph, rel, k, **ends),
            "first_paths": lambda: paths_from(graph, model.from_label, keys=[(model.from_label, rel, model.to_label)]),
        }
        edges = graph.edge(rel, model.from_label, model.to_label)
        numeric = [
            f.name
            for f in edges.schema.fields
            if f.name in model.properties and isinstance(f.dataType, T.NumericType) and f.name not in (SRC, DST)
        ]
        if numeric:
            frames["total"] = lambda: sum_edge_property(graph, rel, numeric[0], k, **ends)
        return frames
    frames = {}
    hubs = [r for r in model.relationships if r.kind == DIMENSION]
    parents = [r for r in model.relationships if r.kind == FOREIGN_KEY]
    if hubs:
        frames["rows_per_value"] = lambda: count_per_target(graph, model.label, hubs[0].rel_type, hubs[0].to_label)
    anchor = (parents or hubs or [None])[0]
    if anchor:
        frames["sharing"] = lambda: shared_neighbor_counts(graph, anchor.rel_type, k, model.label, anchor.to_label)
        frames["first_paths"] = lambda: paths_from(graph, model.label)
    else:
        frames["first_nodes"] = lambda: graph.node(model.label).orderBy(F.col(ID)).limit(300)
    if parents:
        frames["busiest"] = lambda: busiest(graph, parents[0].rel_type, k, model.label, parents[0].to_label)
    if len(model.relationships) > 1:
        frames["shortest_path"] = lambda: _first_two(graph, model.label)
    return frames
