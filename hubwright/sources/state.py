"""High-water marks of synchronised tables, as a table that is only appended to."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Error conditions of a state that is not there or cannot be read.
EMPTY = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE")
STATE_SCHEMA = "source_table string, column string, high_water string, updated_at timestamp"


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Latest entry per table. A missing or unreadable state is an empty one; whatever else goes wrong is an error, or a full load would hide it."""
    try:
        log = spark.read.parquet(path).select("source_table", "column", "high_water", "updated_at")
    except (PySparkException, Py4JJavaError) as error:
        if not any(f"[{condition}" in str(error) for condition in EMPTY):
            raise
        return spark.createDataFrame([], STATE_SCHEMA)
    latest = log.groupBy("source_table").agg(F.max_by(F.struct("column", "high_water", "updated_at"), "updated_at").alias("s"))
    return latest.select("source_table", "s.column", "s.high_water", "s.updated_at")


def write_state(spark: SparkSession, path: str, source_table: str, column: str, high_water: str | None) -> None:
    entry = spark.createDataFrame([(source_table, column, high_water)], "source_table string, column string, high_water string")
    entry.withColumn("updated_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)
