"""Source tables: what a catalog would declare about them, and checks of it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class ForeignKey:
    """Columns of a table that hold the key of another; composite keys pair by position."""

    name: str
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]
    enforced: bool = False

    def __post_init__(self):
        if not self.columns or len(self.columns) != len(self.ref_columns):
            raise ValueError(f"foreign key {self.name}: columns do not pair up with the referenced ones")


#: Names that nodes and edges use themselves; source columns of these names get an underscore at the end.
RESERVED = ("_id", "_key", "src_id", "dst_id")


def _free(names: Sequence[str]) -> tuple[str, ...]:
    return tuple(f"{n}_" if n in RESERVED else n for n in names)


@dataclass(frozen=True)
class TableSpec:
    """A DataFrame with its declared keys.

    Columns named as in ``RESERVED`` are renamed, in the frame and in all keys.

    ``key_enforced`` says that whoever wrote the table guarantees the primary
    key (unique, no NULL), as a database does. Node building then needs no
    shuffle at all. Leave it off to have duplicates resolved, and run
    ``check_primary_key`` to find out which of the two is right.
    """

    name: str
    df: DataFrame
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = field(default_factory=tuple)
    key_enforced: bool = False

    def __post_init__(self):
        if any(c in RESERVED for c in self.df.columns):
            # frozen, but not yet in anyone's hands
            object.__setattr__(self, "df", self.df.toDF(*_free(self.df.columns)))
            object.__setattr__(self, "primary_key", _free(self.primary_key))
        keys = tuple(replace(fk, columns=_free(fk.columns), ref_columns=_free(fk.ref_columns)) for fk in self.foreign_keys)
        object.__setattr__(self, "foreign_keys", keys)
        known = set(self.df.columns)
        for what, columns in [("primary key", self.primary_key)] + [(fk.name, fk.columns) for fk in self.foreign_keys]:
            missing = [c for c in columns if c not in known]
            if missing:
                raise ValueError(f"table {self.name} has no column {', '.join(missing)} ({what})")

    @property
    def foreign_key_columns(self) -> set[str]:
        return {c for fk in self.foreign_keys for c in fk.columns}


def scan_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Named columns only; the Parquet scan reads no others."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def describe_columns(df: DataFrame) -> DataFrame:
    """Position, name, type and nullability of each column. Metadata, no job."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def all_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns])


def check_primary_key(spec: TableSpec) -> DataFrame:
    """Key values that occur more than once or hold a NULL, with their row counts."""
    if not spec.primary_key:
        raise ValueError(f"table {spec.name} declares no primary key")
    counts = spec.df.groupBy(*spec.primary_key).agg(F.count(F.lit(1)).alias("row_count"))
    return counts.where((F.col("row_count") > 1) | ~all_present(spec.primary_key))


def check_foreign_key(spec: TableSpec, key: ForeignKey, parent: TableSpec) -> DataFrame:
    """Key values without a parent row, with the number of rows that hold them.

    Rows are counted per key value first, so a value held by a third of the
    table reaches the join as one row.
    """
    held = (
        spec.df.where(all_present(key.columns)).groupBy(*key.columns).agg(F.count(F.lit(1)).alias("row_count"))
    )
    wanted = parent.df.select(*[F.col(f"`{r}`").alias(c) for c, r in zip(key.columns, key.ref_columns)])
    return held.join(wanted, list(key.columns), "left_anti")
