"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hubwright.session import stage_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def or_empty(text: str | Column) -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def values(column: pa.Array) -> Iterator:
    """The values of an Arrow column one by one, so that a batch of long texts is not held twice."""
    return (v.as_py() for v in column)


def free_name(wanted: str, taken: list[str]) -> str:
    """A column name for internal use that does not clash with the input's columns."""
    lower = {t.lower() for t in taken}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted


def hex_digest(value: Column) -> Column:
    return F.sha2(value, 256)


#: Keys that can be hot at most: each has more than that part of all rows.
MOST_HOT = 1 << 10


#: Copies of a row that one task makes anew.
COPIES_AT_ONCE = 1 << 10


def told_apart(rows: DataFrame, keys: dict[str, Column], name: str, least: int) -> DataFrame:
    """``rows`` with a column ``name``, by which rows that agree in ``keys`` can be dealt to several groups.

    It is 0, but where more than ``least`` rows, and more than a MOST_HOT-th of all, have one key. Such rows get a hash of all
    their columns, and rows that agree in all of them are made one, counted, and made anew with a number each. So the
    value depends on the rows alone and not on how they were partitioned, and a repeated task deals them alike.
    """
    keyed = rows.select(*[value.alias(f"_key_{k}") for k, value in keys.items()])
    counts = keyed.groupBy(*keyed.columns).count()
    # fewer than MOST_HOT rows, as each stands for more than that part of all
    hot = F.broadcast(stage_table(counts.where(F.col("count") > max(least, rows.count() // MOST_HOT)).drop("count")))
    none = F.lit(0).cast("long").alias(name)
    if hot.isEmpty():
        return rows.select("*", none)
    same = reduce(lambda a, b: a & b, [value.eqNullSafe(hot[f"_key_{k}"]) for k, value in keys.items()])
    columns = [F.col(f"`{c}`") for c in rows.columns]
    copies, chunk, number = (free_name(n, rows.columns) for n in ("_copies", "_chunk", "_number"))
    counted = rows.join(hot, same, "left_semi").groupBy(*columns).agg(F.count(F.lit(1)).alias(copies))
    chunks = counted.withColumn(chunk, F.explode(F.sequence(F.lit(0), F.floor((F.col(copies) - 1) / COPIES_AT_ONCE))))
    first = F.col(chunk) * COPIES_AT_ONCE
    anew = chunks.repartition(chunk).withColumn(number, F.explode(F.sequence(first, F.least(first + COPIES_AT_ONCE, F.col(copies)) - 1)))
    return rows.join(hot, same, "left_anti").select("*", none).unionByName(anew.select(*columns, F.xxhash64(*columns, number).alias(name)))
