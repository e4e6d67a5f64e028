"""Which columns take few enough values to become shared hub nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

MAX_DISTINCT = 50
MAX_RATIO = 0.1
SMALL_TABLE_FLOOR = 20
LARGEST_SCREENED = 1000

PROFILE_SCHEMA = "column string, distinct_values bigint, row_count bigint"


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def distinct_cap(row_count: int, max_distinct: int = MAX_DISTINCT, ratio: float = MAX_RATIO) -> int:
    """A tenth of the rows, at least 20 so that small tables qualify, at most 50."""
    return min(max_distinct, max(SMALL_TABLE_FLOOR, int(row_count * ratio)))


def short_form(text: Column) -> Column:
    """The value itself up to 64 characters, a marked digest beyond; no short value looks like one."""
    return F.when(F.length(text) <= 64, text).otherwise(F.concat(F.lit("#"), F.sha2(text, 256)))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct counts (NULL ignored) of several columns in one job, with the row count.

    Every task reduces its rows to counted (column, value) pairs before the
    shuffle, so a frequent value costs one row per task. All values are compared
    as text, long ones by their SHA-256, so that whole documents are not shuffled.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), short_form(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns])
    return (
        df.select(F.inline(cells))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("uses"))
        .groupBy("column")
        .agg(F.count("value").alias("distinct_values"), F.sum("uses").alias("row_count"))
    )


def profile_columns(df: DataFrame) -> DataFrame:
    """Exact distinct count of every text-like column, with the row count; zeros for an empty table."""
    columns = text_columns(df)
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], PROFILE_SCHEMA)
    names = spark.createDataFrame([(c,) for c in columns], "column string")
    counted = names.join(distinct_counts(df, columns), "column", "left")
    return counted.select("column", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("distinct_values", "row_count")])


def screen_columns(df: DataFrame, columns: Sequence[str], max_distinct: int, ratio: float) -> tuple[int, list[str]]:
    """Row count and the columns that may be under the cap; one scan, no shuffle of values.

    The sketch counts empty registers while few are taken, and n values fill at
    most n of its 4096 registers, so its estimate for n <= 50 never exceeds n by
    a full unit: no column under the cap is lost here. What is left gets an exact
    count. Far higher caps leave the range in which that holds and are not screened.
    """
    sketches = [F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(f"d{i}") for i, c in enumerate(columns)]
    found = df.agg(F.count(F.lit(1)).alias("n"), *sketches).first()
    cap = distinct_cap(found["n"], max_distinct, ratio)
    if cap > LARGEST_SCREENED:
        return found["n"], list(columns)
    # n values in m registers are estimated as at most m*ln(m/(m-n)) < n + n*n/m
    limit = cap + 1 + cap * cap // 4096
    return found["n"], [c for i, c in enumerate(columns) if 0 < found[f"d{i}"] <= limit]


def dimension_columns(
    df: DataFrame,
    exclude: Sequence[str] = (),
    max_distinct: int = MAX_DISTINCT,
    ratio: float = MAX_RATIO,
) -> DataFrame:
    """Columns to promote to hubs: more than one value, at most the cap, and some value repeats."""
    columns = [c for c in text_columns(df) if c not in set(exclude)]
    nothing = df.sparkSession.createDataFrame([], PROFILE_SCHEMA)
    if not columns:
        return nothing
    rows, near = screen_columns(df, columns, max_distinct, ratio)
    if not rows or not near:
        return nothing
    cap = distinct_cap(rows, max_distinct, ratio)
    distinct = F.col("distinct_values")
    return distinct_counts(df, near).where((distinct > 1) & (distinct <= cap) & (distinct < F.col("row_count")))
