"""The graph model of a table: inferred, edited by hand, saved as JSON."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import asdict, dataclass, replace
from pathlib import Path

from pyspark.sql import SparkSession

from hubwright.functions.naming import label_of, rel_type_of_column, rel_type_of_table
from hubwright.plans.profile import MAX_DISTINCT, MAX_RATIO, dimension_columns
from hubwright.sources.tables import ForeignKey, TableSpec

ROW_KEY = "_row_key"
HUB_KEY = "value"
FOREIGN_KEY = "foreign_key"
DIMENSION = "dimension"


@dataclass(frozen=True)
class Relationship:
    """An edge from each row's node to the node its columns name."""

    kind: str
    rel_type: str
    to_label: str
    via: tuple[str, ...]
    to_key: tuple[str, ...]
    self_reference: bool = False
    distinct_values: int | None = None
    enforced: bool = False


@dataclass(frozen=True)
class NodeModel:
    """Rows become nodes. Without a primary key the key is a hash of all columns."""

    table: str
    label: str
    key: tuple[str, ...]
    key_from: tuple[str, ...] | None
    properties: tuple[str, ...]
    relationships: tuple[Relationship, ...]

    @property
    def synthetic(self) -> bool:
        return self.key_from is not None

    def rename(self, label: str | None = None, rel_types: dict | None = None, to_labels: dict | None = None):
        """Give the label, edge types or target labels (old name -> new name) other names."""
        types, targets = rel_types or {}, to_labels or {}
        unknown = set(types) - {r.rel_type for r in self.relationships} | set(targets) - {r.to_label for r in self.relationships}
        if unknown:
            raise KeyError(f"no such name in the model of {self.table}: {', '.join(sorted(unknown))}")
        renamed = tuple(
            replace(r, rel_type=types.get(r.rel_type, r.rel_type), to_label=targets.get(r.to_label, r.to_label))
            for r in self.relationships
        )
        return replace(self, label=label or self.label, relationships=renamed)

    def drop(self, rel_type: str):
        """Leave a relationship out; its column is kept as a property again."""
        gone = [r for r in self.relationships if r.rel_type == rel_type]
        if not gone:
            raise KeyError(f"no relationship {rel_type} in the model of {self.table}")
        back = [c for r in gone for c in r.via if c not in self.properties]
        return replace(
            self,
            relationships=tuple(r for r in self.relationships if r.rel_type != rel_type),
            properties=self.properties + tuple(back),
        )

    def add(self, relationship: Relationship):
        """Add a relationship; its columns are folded out of the properties."""
        folded = tuple(p for p in self.properties if p not in relationship.via or p in self.key)
        return replace(self, relationships=self.relationships + (relationship,), properties=folded)


@dataclass(frozen=True)
class JoinModel:
    """Rows of a link table become edges with properties."""

    table: str
    rel_type: str
    from_label: str
    from_via: tuple[str, ...]
    from_key: tuple[str, ...]
    to_label: str
    to_via: tuple[str, ...]
    to_key: tuple[str, ...]
    properties: tuple[str, ...]

    def rename(self, rel_type: str | None = None, from_label: str | None = None, to_label: str | None = None):
        return replace(
            self,
            rel_type=rel_type or self.rel_type,
            from_label=from_label or self.from_label,
            to_label=to_label or self.to_label,
        )


Model = NodeModel | JoinModel


def _local_name(table: str) -> str:
    return table.rsplit(".", 1)[-1]


def link_keys(spec: TableSpec) -> tuple[ForeignKey, ForeignKey] | None:
    """The two foreign keys of a link table, or None.

    A link table has a primary key of two columns that belong to two different
    foreign keys. Two halves of one composite foreign key mark a detail table.
    """
    if len(spec.primary_key) != 2:
        return None
    owners = [[fk for fk in spec.foreign_keys if column in fk.columns] for column in spec.primary_key]
    if not all(owners):
        return None
    first, second = owners[0][-1], owners[1][-1]
    return (first, second) if first.name != second.name else None


def is_join_table(spec: TableSpec) -> bool:
    return link_keys(spec) is not None


def _infer_join(spec: TableSpec, first: ForeignKey, second: ForeignKey) -> JoinModel:
    ends = set(first.columns) | set(second.columns)
    return JoinModel(
        table=spec.name,
        rel_type=rel_type_of_table(_local_name(spec.name)),
        from_label=label_of(_local_name(first.ref_table)),
        from_via=first.columns,
        from_key=first.ref_columns,
        to_label=label_of(_local_name(second.ref_table)),
        to_via=second.columns,
        to_key=second.ref_columns,
        properties=tuple(c for c in spec.df.columns if c not in ends),
    )


def _foreign_relationship(spec: TableSpec, fk: ForeignKey) -> Relationship:
    parent = _local_name(fk.ref_table)
    rel_type = rel_type_of_column(fk.columns[0]) if len(fk.columns) == 1 else f"HAS_{rel_type_of_table(parent)}"
    return Relationship(
        kind=FOREIGN_KEY,
        rel_type=rel_type,
        to_label=label_of(parent),
        via=fk.columns,
        to_key=fk.ref_columns,
        self_reference=fk.ref_table == spec.name,
        enforced=fk.enforced,
    )


def _told_apart(relationships: list[Relationship], keys: tuple[ForeignKey, ...]) -> list[Relationship]:
    """Keys that would share type and target, such as two addresses of an order, are named by their constraints."""
    uses = Counter((r.rel_type, r.to_label) for r in relationships)
    return [
        replace(r, rel_type=rel_type_of_column(fk.name)) if uses[r.rel_type, r.to_label] > 1 else r
        for r, fk in zip(relationships, keys)
    ]


def infer_model(spec: TableSpec, max_distinct: int = MAX_DISTINCT, ratio: float = MAX_RATIO) -> Model:
    """Propose a graph model for a table: one scan to screen, one small job to count exactly.

    At most one row per text column comes back to the driver.
    """
    ends = link_keys(spec)
    if ends:
        return _infer_join(spec, *ends)
    linked = spec.foreign_key_columns
    found = dimension_columns(spec.df, sorted(linked | set(spec.primary_key)), max_distinct, ratio)
    counts = {row["column"]: row["distinct_values"] for row in found.collect()}
    hubs = [c for c in spec.df.columns if c in counts]
    folded = (linked | set(hubs)) - set(spec.primary_key)
    relationships = _told_apart([_foreign_relationship(spec, fk) for fk in spec.foreign_keys], spec.foreign_keys)
    relationships += [
        Relationship(DIMENSION, rel_type_of_column(c), label_of(c), (c,), (HUB_KEY,), distinct_values=counts[c])
        for c in hubs
    ]
    return NodeModel(
        table=spec.name,
        label=label_of(_local_name(spec.name)),
        key=spec.primary_key or (ROW_KEY,),
        key_from=None if spec.primary_key else tuple(spec.df.columns),
        properties=tuple(c for c in spec.df.columns if c not in folded),
        relationships=tuple(relationships),
    )


def model_rows(model: Model) -> list[tuple]:
    """One line per edge type of a model: table, mode, label, key, kind, type, target, columns, distinct."""
    if isinstance(model, JoinModel):
        return [(
            model.table, "join", model.from_label, ",".join(model.from_via), "join", model.rel_type,
            model.to_label, ",".join(model.to_via), False, None,
        )]
    return [
        (
            model.table, "node", model.label, ",".join(model.key), r.kind, r.rel_type,
            r.to_label, ",".join(r.via), r.self_reference, r.distinct_values,
        )
        for r in model.relationships
    ]


MODEL_ROW_SCHEMA = (
    "source_table string, mode string, label string, key string, kind string, rel_type string, "
    "to_label string, via string, self_reference boolean, distinct_values bigint"
)


def to_json(model: Model) -> str:
    mode = "join" if isinstance(model, JoinModel) else "node"
    return json.dumps({"mode": mode, **asdict(model)}, indent=2)


def from_json(text: str) -> Model:
    data = json.loads(text)
    kind = JoinModel if data.pop("mode") == "join" else NodeModel
    relationships = data.pop("relationships", None)
    fields = {k: tuple(v) if isinstance(v, list) else v for k, v in data.items()}
    if relationships is not None:
        fields["relationships"] = tuple(
            Relationship(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}) for r in relationships
        )
    return kind(**fields)


def save_model(model: Model, path: str | Path) -> None:
    """Write the model where a person can edit it before the load."""
    Path(path).write_text(to_json(model) + "\n")


def load_model(path: str | Path) -> Model:
    return from_json(Path(path).read_text())


def write_model(spark: SparkSession, model: Model, path: str) -> None:
    """Write the model as a text file into any store that Spark writes to."""
    spark.createDataFrame([(to_json(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_model(spark: SparkSession, path: str) -> Model:
    return from_json(spark.read.text(path, wholetext=True).first()["value"])
