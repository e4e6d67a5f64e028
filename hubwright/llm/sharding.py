"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into buckets by a seeded hash, uniformly whatever their
source or text; a bucket fits a task's memory. Pass two shuffles each bucket by
Fisher-Yates and writes it. Buckets follow one another in one global order, which is
cut into shards of equal row counts.

A repeated task gives the same order: a bucket is sorted before it is shuffled, and its random numbers
come from the seed and its own number.

Defined results: a null text weighs its 16 bytes and stays null in the files; rows that repeat are kept
each; with fewer rows than shards some shards are empty; an empty table gives empty files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hubwright.llm.common import free_name, table, told_apart
from hubwright.session import staged_path

SHARDS, SEED = 40, 20_240_501
#: Text bytes of a bucket, on average; a task holds one bucket.
BUCKET_BYTES = 32 << 20
#: Rows of one id and size from which on they are dealt to several buckets.
LEAST_HOT = 1 << 10
#: A record's bytes beside its text.
RECORD_BYTES = 16


def record_size(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long")


def text_crc32(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def cut(position: np.ndarray, total: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of a place in the global order: shards differ by one row at most."""
    shard = position * shards // total
    first = -(-shard * total // shards)
    return shard, position - first


def external_shuffle(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all rows below ``path``, one folder per shard, in shuffled order; returns them as read back.

    Adds ``shard`` and ``slot``, named otherwise where the input has such columns.
    """
    spark = docs.sparkSession
    shard_name, slot_name = free_name("shard", docs.columns), free_name("slot", docs.columns)
    bucket, crc = free_name("bucket", docs.columns), free_name("text_crc32", docs.columns)

    lot, whole = free_name("lot", docs.columns), free_name("row_hash", docs.columns)
    total_bytes = docs.agg(F.sum(record_size(text))).first()[0] or 0
    buckets = max(1, -(-total_bytes // bucket_bytes))
    # many rows with one id and size are told apart
    told = told_apart(docs, {"id": F.col(f"`{doc_id}`"), "size": record_size(text)}, lot, LEAST_HOT)
    scattered = told.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), doc_id, record_size(text), lot), F.lit(buckets))).drop(lot)
    # counts of buckets, not of rows: their number is the corpus over a task's memory
    counts = np.zeros(buckets, np.int64)
    for number, n in scattered.groupBy(bucket).count().collect():
        counts[number] = n
    starts, total = np.cumsum(counts) - counts, int(counts.sum())

    def shuffle(rows: pa.Table) -> pa.Table:
        number = rows.column(bucket)[0].as_py()
        rows = rows.take(pc.sort_indices(rows, [(doc_id, "ascending"), (crc, "ascending"), (whole, "ascending")]))
        order = np.arange(len(rows))
        np.random.default_rng([seed, number]).shuffle(order)  # Fisher-Yates
        shard, slot = cut(starts[number] + np.arange(len(rows)), total, shards)
        rows = rows.drop_columns([bucket, crc, whole]).take(pa.array(order))
        return rows.append_column(shard_name, pa.array(shard.astype(np.int32))).append_column(slot_name, pa.array(slot))

    schema = docs.withColumn(shard_name, F.lit(0)).withColumn(slot_name, F.lit(0).cast("long")).schema
    # rows that agree in all columns may change places, others are put in one order
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    shuffled = scattered.withColumn(crc, text_crc32(text)).withColumn(whole, hashed).groupBy(bucket).applyInArrow(shuffle, schema)
    shuffled.sortWithinPartitions(shard_name, slot_name).write.partitionBy(shard_name).parquet(path)
    # with its schema: an empty table leaves no file to read it from
    return spark.read.schema(schema).parquet(path)


def op9_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the shards, from the files written."""
    docs = table(spark, sf_dir, "documents")
    written = external_shuffle(docs, staged_path(spark))
    return written.select(
        "doc_id",
        record_size("text").alias("size"),
        text_crc32("text").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
