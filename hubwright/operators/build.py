"""Tables to nodes and edges."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from hubwright.functions.values import node_id, synthetic_key
from hubwright.operators.graph import DST, EDGE_ENDS, ID, KEY, SRC, EdgeKey, PropertyGraph, property_names, union_by_name
from hubwright.operators.upsert import upsert_nodes
from hubwright.plans.model import DIMENSION, FOREIGN_KEY, HUB_KEY, ROW_KEY, JoinModel, Model, NodeModel, Relationship
from hubwright.sources.tables import TableSpec, all_present


def _id_of(df: DataFrame, names: Iterable[str], columns: Iterable[str]):
    """Identity under key properties ``names``, with values from ``columns`` of the frame."""
    return node_id([(n, F.col(f"`{c}`"), df.schema[c].dataType) for n, c in zip(names, columns)])


def keyed_rows(df: DataFrame, model: NodeModel) -> DataFrame:
    """Source rows with the identity of their node; rows without a key make no node."""
    if not model.synthetic:
        df = df.where(all_present(model.key))
    elif ROW_KEY not in df.columns:
        cells = [(F.col(f"`{c}`"), df.schema[c].dataType) for c in model.key_from]
        df = df.withColumn(ROW_KEY, synthetic_key(cells))
    return df.withColumn(ID, _id_of(df, model.key, model.key))


def _has_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.StructType):
        return any(_has_map(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return _has_map(data_type.elementType)
    return isinstance(data_type, T.MapType)


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the same one on every run: the greatest of its copies.

    Copies are reduced inside each task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    if any(_has_map(df.schema[c].dataType) for c in rest):
        # maps cannot be compared, but their text can; sorted entries make equal maps equal texts
        text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest]))
        best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), text).alias("_best"))
        return best.select(*keys, *[F.col(f"_best.`{c}`").alias(c) for c in rest]).select(*df.columns)
    best = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.`{c}`").alias(c) for c in rest]).select(*df.columns)


def build_nodes(df: DataFrame, model: NodeModel, unique: bool = False) -> DataFrame:
    """One node per key. Rows known to be unique need no shuffle, the plan is a projection."""
    if model.synthetic and not unique:
        # equal rows are one node, and each is hashed once; what is derived from them is not shuffled
        df = df.select(*[F.col(f"`{c}`") for c in model.key_from]).distinct()
    rows = keyed_rows(df, model)
    columns = list(dict.fromkeys((*model.key, *model.properties)))
    nodes = rows.select(ID, F.lit(",".join(model.key)).alias(KEY), *[F.col(f"`{c}`") for c in columns])
    if unique or model.synthetic:
        return nodes
    return one_per_key(nodes, [ID])


def build_dimension_nodes(df: DataFrame, rel: Relationship) -> DataFrame:
    """One hub per distinct value. Tasks send each value once, however often it occurs."""
    values = df.select(F.col(f"`{rel.via[0]}`").alias(HUB_KEY)).where(F.col(HUB_KEY).isNotNull()).distinct()
    return values.select(_id_of(values, (HUB_KEY,), (HUB_KEY,)).alias(ID), F.lit(HUB_KEY).alias(KEY), HUB_KEY)


def build_edges(df: DataFrame, model: NodeModel, rel: Relationship, unique: bool = False) -> DataFrame:
    """From each row's node to the node its columns name; none where one of them is NULL.

    The target's identity is made of the row's own values, so no join to the
    target is needed.
    """
    rows = keyed_rows(df.where(all_present(rel.via)), model)
    edges = rows.select(F.col(ID).alias(SRC), _id_of(rows, rel.to_key, rel.via).alias(DST))
    return edges if unique else edges.distinct()


def build_stub_nodes(df: DataFrame, key: Iterable[str], via: Iterable[str]) -> DataFrame:
    """Referenced keys as nodes that hold nothing but their key."""
    key, via = tuple(key), tuple(via)
    values = df.where(all_present(via)).select(*[F.col(f"`{c}`").alias(k) for k, c in zip(key, via)]).distinct()
    return values.select(_id_of(values, key, key).alias(ID), F.lit(",".join(key)).alias(KEY), *key)


def build_join_edges(df: DataFrame, model: JoinModel, unique: bool = False) -> DataFrame:
    """Rows of a link table as edges with properties, one per pair of ends."""
    edges = df.where(all_present([*model.from_via, *model.to_via])).select(
        _id_of(df, model.from_key, model.from_via).alias(SRC),
        _id_of(df, model.to_key, model.to_via).alias(DST),
        *[F.col(f"`{c}`") for c in model.properties],
    )
    return edges if unique else one_per_key(edges, list(EDGE_ENDS))


def skipped_null_endpoints(df: DataFrame, model: JoinModel) -> DataFrame:
    """How many rows of a link table cannot become an edge."""
    absent = ~all_present([*model.from_via, *model.to_via])
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(absent).alias("skipped"))


def _with_stubs(known: DataFrame | None, stubs: list[DataFrame]) -> DataFrame:
    """Add the referenced keys that no loaded row has."""
    wanted = stubs[0] if len(stubs) == 1 else union_by_name(stubs).dropDuplicates([ID])
    if known is None:
        return wanted
    return union_by_name([known, wanted.join(known.select(ID), ID, "left_anti")])


class _Parts:
    """What the loads contribute to one label, by key property."""

    def __init__(self):
        self.rows: dict[str, list[DataFrame]] = defaultdict(list)
        self.stubs: dict[str, list[tuple[DataFrame, bool]]] = defaultdict(list)

    def frame(self) -> DataFrame:
        frames = []
        for key in sorted(set(self.rows) | set(self.stubs)):
            loads = self.rows[key]
            if not loads:
                known = None
            elif all(property_names(f) == [HUB_KEY] for f in loads):
                known = loads[0] if len(loads) == 1 else union_by_name(loads).dropDuplicates([ID])
            else:
                known = reduce(upsert_nodes, loads)
            stubs = [f for f, enforced in self.stubs[key] if not (enforced and loads)]
            frames.append(_with_stubs(known, stubs) if stubs else known)
        return union_by_name(frames)


def build_graph(
    loads: Iterable[tuple[TableSpec, Model]],
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> PropertyGraph:
    """Several tables as one graph.

    Tables that share a label meet in one node table, and referenced rows that
    no table supplies become key-only nodes. A foreign key that is enforced
    against a loaded table adds none and costs no join. ``stage`` may
    materialise the hashed rows of tables without a key (``stage_table``), so
    that each edge type reads two columns instead of hashing all of them anew.
    """
    labels: dict[str, _Parts] = defaultdict(_Parts)
    edges: dict[EdgeKey, list[DataFrame]] = defaultdict(list)
    for spec, model in loads:
        if isinstance(model, JoinModel):
            for label, key, via in ((model.from_label, model.from_key, model.from_via), (model.to_label, model.to_key, model.to_via)):
                enforced = any(fk.enforced for fk in spec.foreign_keys if fk.columns == via)
                # an end without its partner makes no node either
                usable = spec.df.dropna(subset=[*model.from_via, *model.to_via])
                labels[label].stubs[",".join(key)].append((build_stub_nodes(usable, key, via), enforced))
            edges[model.from_label, model.rel_type, model.to_label].append(build_join_edges(spec.df, model, spec.key_enforced))
            continue
        df, unique = spec.df, spec.key_enforced and not model.synthetic
        if model.synthetic and stage is not None:
            df, unique = stage(keyed_rows(df, model).drop(ID).distinct()), True
        labels[model.label].rows[",".join(model.key)].append(build_nodes(df, model, unique))
        for rel in model.relationships:
            if rel.kind == DIMENSION:
                labels[rel.to_label].rows[HUB_KEY].append(build_dimension_nodes(df, rel))
            elif rel.kind == FOREIGN_KEY:
                labels[rel.to_label].stubs[",".join(rel.to_key)].append((build_stub_nodes(df, rel.to_key, rel.via), rel.enforced))
            edges[model.label, rel.rel_type, rel.to_label].append(build_edges(df, model, rel, unique))
    return PropertyGraph(
        {label: parts.frame() for label, parts in labels.items()},
        {key: frames[0] if len(frames) == 1 else one_per_key(union_by_name(frames), list(EDGE_ENDS)) for key, frames in edges.items()},
    )


def wipe_label(graph: PropertyGraph, label: str) -> PropertyGraph:
    """Drop a label with every edge that touches it; hubs of its rows stay."""
    return PropertyGraph(
        {k: v for k, v in graph.nodes.items() if k != label},
        {k: v for k, v in graph.edges.items() if label not in (k[0], k[2])},
    )


def load_summary(graph: PropertyGraph) -> DataFrame:
    """Nodes per label and edges per type, in one frame."""
    nodes = graph.all_nodes().groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    edges = graph.all_edges().groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    return nodes.select(F.lit("node").alias("kind"), "name", "count").unionByName(
        edges.select(F.lit("edge").alias("kind"), "name", "count")
    )
