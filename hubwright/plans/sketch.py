"""A profile that is kept: counts, small value sets and sketches per column, brought up to date from new rows alone.

For every text-like column the state holds the number of rows, the distinct values while there are at most
``KEPT_VALUES`` of them (long ones by a digest), and a sketch of all values. Two states of disjoint rows are merged
without reading a row: counts are added, sets united, sketches united. A set that grows beyond the limit is given up, as it can
only grow on; the sketch then gives an estimate. Which columns become hubs is decided by exact sets, so it is the
same as by a new profile of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hubwright.plans.profile import MAX_DISTINCT, MAX_RATIO, SMALL_TABLE_FLOOR, short_form, text_columns

#: Values that a column's set holds at most; caps of up to that size are decided exactly.
KEPT_VALUES = 1000
#: Bits of a sketch's register number: 4096 registers, a standard error of 1.6 %.
SKETCH_BITS = 12

STATE = "column string, row_count bigint, values array<string>, sketch binary"


def _narrow(state: DataFrame, kept: int) -> DataFrame:
    """Sets above the limit become NULL."""
    return state.withColumn("values", F.when(F.size("values") <= kept, F.array_sort("values")))


def profile_state(df: DataFrame, kept: int = KEPT_VALUES) -> DataFrame:
    """column, row_count, values, sketch of each text-like column.

    One scan sketches all columns; values are collected in a second one, of columns whose estimate is near the limit or below alone.
    """
    spark, columns = df.sparkSession, text_columns(df)
    if not columns:
        return spark.createDataFrame([], STATE)
    text = {c: short_form(F.col(f"`{c}`").cast("string")) for c in columns}
    sketches = [F.hll_sketch_agg(text[c], SKETCH_BITS).alias(f"s{i}") for i, c in enumerate(columns)]
    found = df.agg(F.count(F.lit(1)).alias("n"), *sketches).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("row_count"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)]))
    )
    rows = found.withColumn("estimate", F.hll_sketch_estimate("sketch")).collect()  # one row per column
    made = spark.createDataFrame([r[:3] for r in rows], "column string, row_count bigint, sketch binary")
    # far beyond the sketch's error: ten standard errors at the limit
    near = [r["column"] for r in rows if r["estimate"] <= kept * 1.2 + 10]
    if not near:
        return made.select("column", "row_count", F.lit(None).cast("array<string>").alias("values"), "sketch")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), text[c].alias("value")) for c in near])
    distinct = df.select(F.inline(cells)).where("value is not null").distinct()
    # at most 1.2 times the limit per column, so the sets are small
    sets = distinct.groupBy("column").agg(F.collect_list("value").alias("values"))
    empty = F.when(F.col("column").isin(near), F.array().cast("array<string>"))
    joined = made.join(F.broadcast(sets), "column", "left").withColumn("values", F.coalesce("values", empty))
    return _narrow(joined, kept).select("column", "row_count", "values", "sketch")


def merge_states(*states: DataFrame, kept: int = KEPT_VALUES) -> DataFrame:
    """The state of all rows of several states. A column that one of them lacks was not there: its rows count as NULL."""
    whole = states[0]
    for more in states[1:]:
        whole = whole.unionByName(more)
    known = F.bool_and(F.col("values").isNotNull())
    merged = whole.groupBy("column").agg(
        F.sum("row_count").alias("row_count"),
        F.when(known, F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"),
        F.hll_union_agg("sketch", True).alias("sketch"),
    )
    return _narrow(merged, kept).select("column", "row_count", "values", "sketch")


def distinct_of(state: DataFrame) -> DataFrame:
    """column, distinct_values, row_count, exact: from the set while it is kept, from the sketch beyond."""
    exact = F.col("values").isNotNull()
    return state.select(
        "column", F.when(exact, F.size("values").cast("bigint")).otherwise(F.hll_sketch_estimate("sketch")).alias("distinct_values"), "row_count", exact.alias("exact")
    )


def dimension_columns_of(state: DataFrame, exclude: Sequence[str] = (), max_distinct: int = MAX_DISTINCT, ratio: float = MAX_RATIO, kept: int = KEPT_VALUES) -> DataFrame:
    """``dimension_columns`` from a kept state. Caps must lie within the kept sets."""
    if max(max_distinct, SMALL_TABLE_FLOOR) > kept:
        raise ValueError(f"sets of {kept} values cannot decide a cap of {max_distinct}")
    cap: Column = F.least(F.lit(max_distinct), F.greatest(F.lit(SMALL_TABLE_FLOOR), F.floor(F.col("row_count") * ratio)))
    distinct = F.col("distinct_values")
    wanted = distinct_of(state).where("exact").where(~F.col("column").isin(list(exclude)) if exclude else F.lit(True))
    return wanted.where((distinct > 1) & (distinct <= cap) & (distinct < F.col("row_count"))).select("column", "distinct_values", "row_count")


def save_state(state: DataFrame, path: str) -> None:
    """Append what new rows add; nothing that is there is read or rewritten."""
    state.write.mode("append").parquet(path)


def load_state(spark, path: str, kept: int = KEPT_VALUES) -> DataFrame:
    """The state of all rows whose states were saved under ``path``: as many small rows as saves and columns."""
    return merge_states(spark.read.schema(STATE).parquet(path), kept=kept)
