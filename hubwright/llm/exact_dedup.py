"""Exact duplicates by an extendible-hash index on shared files, with DataFrame functions only.

Texts are equal when identical after every run of ASCII white space is one space.

1. ``entries``: one narrow row per document: id, 64-bit key and SHA-256 of its normalised text, and its bytes.
2. ``grow_directory``: the directory starts with one slot and doubles while a bucket holds more
   bytes than its capacity; only overfull buckets are split, so several slots may share one.
3. ``dealt``: every row goes to the task that owns its bucket, the one shuffle of texts. There rows are sorted by key and compared
   by their bytes; different texts of one key are told apart. A key with more than a ``MOST_HOT``-th of all bytes
   (so at most ``MOST_HOT``) can be split by no directory: each task first makes its copies one row.
4. ``unique_rows`` lets one whole row of each text leave from the owner. ``build_index`` writes the buckets to the
   shared folder, texts of one key chained; ``lookup`` finds each document's place by key and along the chain.

Defined results: a null text counts as empty, and empty texts are equal to each other; of equal
texts the row with the smallest id stays; with several rows of that id, all of them are marked as kept, and ``unique_rows`` takes one;
a null id never stays beside a known one; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hubwright.llm.common import hex_digest, or_empty, table
from hubwright.session import stage_table, staged_path

WHITE = r"[\x20\x09-\x0D]+"
#: Bytes of texts in a bucket, and slots of the directory at most; beyond that capacity grows with the corpus.
BUCKET_BYTES, MOST_SLOTS = 1 << 22, 1 << 16
#: Keys that can be hot at most: each has more than that part of all bytes, and more than a bucket.
MOST_HOT = 1 << 10
#: How many doublings one count of keys serves.
DOUBLINGS = 8

Key = Callable[[Column], Column]


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(or_empty(text), WHITE, " ")


def entries(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: Key = F.xxhash64) -> DataFrame:
    value = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("value"))
    return value.select("doc_id", key(F.col("value")).cast("long").alias("key"), hex_digest(F.col("value")).alias("text_sha256"), F.octet_length("value").alias("bytes"))


def slot(depth: int, key: str = "key") -> Column:
    """The directory's slot of a key: its first ``depth`` bits."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


@dataclass(frozen=True)
class Directory:
    """``depth`` bits choose one of 2**depth slots; ``buckets`` gives each slot's bucket, by its first slot."""

    depth: int
    buckets: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(slot, bucket); at most MOST_SLOTS rows, so it may be broadcast."""
        return F.broadcast(spark.createDataFrame(list(enumerate(self.buckets)), "slot long, bucket long"))


def grow_directory(keys: DataFrame, total: int, bucket_bytes: int = BUCKET_BYTES, most_slots: int = MOST_SLOTS) -> Directory:
    """``keys`` (key, bytes): written before. The driver sees sums per slot only."""
    capacity = max(bucket_bytes, 2 * total // most_slots)
    depth, local = 0, [(0, 0)]  # buckets as (local depth, prefix)
    counts: dict[int, int] = {0: total}
    counted = 0
    while True:
        overfull = {b for b in local if _bytes_in(b, counts, counted) > capacity}
        if not overfull or (1 << (depth + 1)) > most_slots:
            break
        if depth == counted:
            counted = min(counted + DOUBLINGS, most_slots.bit_length() - 1)
            counts = dict(keys.groupBy(slot(counted).alias("slot")).agg(F.sum("bytes")).collect())
        depth += 1
        local = [b for b in local if b not in overfull] + [(d + 1, 2 * p + i) for d, p in overfull for i in (0, 1)]
    slots = [0] * (1 << depth)
    for d, p in local:
        first = p << (depth - d)
        slots[first : first + (1 << (depth - d))] = [first] * (1 << (depth - d))
    return Directory(depth, tuple(slots))


def _bytes_in(bucket: tuple[int, int], counts: dict[int, int], counted: int) -> int:
    depth, prefix = bucket
    return sum(counts.get(s, 0) for s in range(prefix << (counted - depth), (prefix + 1) << (counted - depth)))


def plan_buckets(keys: DataFrame, bucket_bytes: int = BUCKET_BYTES, most_slots: int = MOST_SLOTS) -> tuple[Directory, DataFrame, int]:
    """The directory over ``keys`` (key, bytes: distinct, written before), the hot keys and their number."""
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    often = F.col("bytes") > max(bucket_bytes, total // MOST_HOT)
    hot = stage_table(keys.where(often).select("key"))
    rest = keys.where(~often)
    return grow_directory(rest, rest.agg(F.sum("bytes")).first()[0] or 0, bucket_bytes, most_slots), F.broadcast(hot), hot.count()


def dealt(rows: DataFrame, value: Column, directory: Directory, hot: DataFrame, n_hot: int, *found: Column) -> DataFrame:
    """One row per different text: bucket, key, value and the aggregates ``found``, made by the task that owns the bucket.

    ``rows``: key and whatever ``value`` (the normalised text) and ``found`` read.
    """
    if directory.depth:
        placed = rows.withColumn("slot", slot(directory.depth)).join(directory.frame(rows.sparkSession), "slot").drop("slot")
    else:  # one bucket: nothing to look up
        placed = rows.withColumn("bucket", F.lit(0).cast("long"))
    # the value is made where the row has come to: a row travels with its text once
    once = placed.join(hot, "key", "left_anti").repartition("bucket").withColumn("value", value)
    groups = once.groupBy("bucket", "key", "value").agg(*found)
    if n_hot:
        # Spark reduces each task's copies before this shuffle
        copies = placed.join(hot, "key", "left_semi").withColumn("value", value)
        groups = groups.unionByName(copies.groupBy("bucket", "key", "value").agg(*found))
    return groups


def build_index(groups: DataFrame, path: str) -> DataFrame:
    """Write each bucket to one file, sorted by key, by one task; the texts of one key are its chain.

    ``groups``: bucket, key, text_sha256, keep_id, group_size.
    """
    chain = F.struct("text_sha256", "keep_id", "group_size")
    chained = groups.repartition("bucket").groupBy("bucket", "key").agg(F.sort_array(F.collect_list(chain)).alias("chain"))
    chained.sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(path)
    # with its schema: an empty index has no file to read it from
    return groups.sparkSession.read.schema(chained.schema).parquet(path)


def lookup(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Each entry with its group: by key, then along the chain to the text's own digest."""
    found = index.select("key", F.explode("chain").alias("link")).select("key", "link.*")
    return rows.join(found, ["key", "text_sha256"])


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: Key = F.xxhash64, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    rows = stage_table(entries(docs, doc_id, text, key))
    keys = stage_table(rows.groupBy("key").agg(F.sum("bytes").alias("bytes")))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("text"))
    found = F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    groups = dealt(narrow.withColumn("key", key(F.col("text")).cast("long")), F.col("text"), *plan_buckets(keys, bucket_bytes), *found)
    index = build_index(groups.select("bucket", "key", hex_digest(F.col("value")).alias("text_sha256"), "keep_id", "group_size"), staged_path(docs.sparkSession))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return lookup(rows, index).select(F.col("doc_id").alias(doc_id), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def unique_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: Key = F.xxhash64, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with one row of each text: one of those with the smallest id, a null id last. It leaves from the task that owns its bucket."""
    value = normalised(F.col("row")[text])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("key", key(value).cast("long"))
    keys = stage_table(rows.select("key", F.octet_length(value).alias("bytes")).groupBy("key").agg(F.sum("bytes").alias("bytes")))
    order = F.struct(F.col("row")[doc_id].isNull(), F.col("row")[doc_id], F.xxhash64("row"))
    groups = dealt(rows, value, *plan_buckets(keys, bucket_bytes), F.min_by("row", order).alias("row"))
    return groups.select("row.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with the one of its group that stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
