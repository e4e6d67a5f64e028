"""Column functions on node keys and property values. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

VALUE_CAP = 120
IDENT_PROPERTIES = ("id", "name", "value", "_row_key")


def _iso_timestamp(text: Column) -> Column:
    """``2024-01-01 00:00:07.17`` -> ``2024-01-01T00:00:07.170000``."""
    stamp = F.replace(text, F.lit(" "), F.lit("T"))
    whole = F.substring_index(stamp, ".", 1)
    fraction = F.rpad(F.substring_index(stamp, ".", -1), 6, "0")
    return F.when(F.contains(stamp, F.lit(".")), F.concat(whole, F.lit("."), fraction)).otherwise(stamp)


def to_graph_value(column: Column, data_type: T.DataType) -> Column:
    """A property value as plain JSON could carry it.

    Dates and times become ISO text, decimals doubles, bytes lower-case hex,
    nested values JSON text. Everything else is returned as it is.
    """
    if isinstance(data_type, T.DateType):
        return column.cast("string")
    if isinstance(data_type, T.TimestampNTZType):
        return _iso_timestamp(column.cast("string"))
    if isinstance(data_type, T.TimestampType):
        utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), column.cast("timestamp_ntz"))
        return F.concat(_iso_timestamp(utc.cast("string")), F.lit("+00:00"))
    if isinstance(data_type, T.DecimalType):
        return column.cast("double")
    if isinstance(data_type, T.BinaryType):
        return F.lower(F.hex(column))
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column


def to_text(column: Column, data_type: T.DataType) -> Column:
    """The text form used in identities, keys and dedupe values."""
    return to_graph_value(column, data_type).cast("string")


def synthetic_key(columns: Sequence[tuple[Column, T.DataType]]) -> Column:
    """SHA-1 over all values of a row, for tables without a primary key.

    Every value is framed by its length and NULL has its own mark, so rows
    that differ only in where one value ends never share a key.
    """
    framed = []
    for column, data_type in columns:
        text = to_text(column, data_type)
        framed.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha1(F.concat_ws(",", *framed))


def node_id(key: Sequence[tuple[str, Column, T.DataType]]) -> Column:
    """Identity of a node: ``key=value``, or JSON of all parts of a composite key.

    NULL as soon as one part is NULL, which is what "no edge for this row" needs.
    """
    if len(key) == 1:
        name, column, data_type = key[0]
        return F.concat(F.lit(f"{name}="), to_text(column, data_type))
    present = None
    for _, column, _ in key:
        present = column.isNotNull() if present is None else present & column.isNotNull()
    parts = [to_graph_value(column, data_type).alias(name) for name, column, data_type in key]
    return F.when(present, F.to_json(F.struct(*parts)))


def truncate_value(column: Column, cap: int = VALUE_CAP) -> Column:
    return F.when(F.length(column) > cap, F.concat(F.substring(column, 1, cap), F.lit("…"))).otherwise(column)


def property_keys(names: Sequence[str]) -> Column:
    """Names of the properties a node has, that is, of its non-NULL columns."""
    return F.array_compact(F.array(*[F.when(F.col(f"`{n}`").isNotNull(), F.lit(n)) for n in sorted(names)]))


def ident_list(schema: T.StructType) -> Column:
    """``k=v`` for each identifying property a node has."""
    types = {f.name: f.dataType for f in schema.fields}
    found = [
        F.concat(F.lit(f"{name}="), to_text(F.col(f"`{name}`"), types[name]))
        for name in IDENT_PROPERTIES
        if name in types
    ]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def property_entries(schema: T.StructType) -> Column:
    """Properties as ``array<struct<key,value>>`` in column order, absent ones left out."""
    entries = [
        F.struct(F.lit(f.name).alias("key"), to_text(F.col(f"`{f.name}`"), f.dataType).alias("value"))
        for f in schema.fields
    ]
    if not entries:
        return F.array().cast("array<struct<key:string,value:string>>")
    return F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
