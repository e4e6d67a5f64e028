"""Clean and pack a corpus: ``STAGES`` in order, each over all rows that its predecessor kept.

All stages but the last return the columns of ``documents``. Rejected documents go, of equal
texts and of near copies one document stays, secrets are masked in place, and what is left
is packed into windows. Every row is decided by its own text, whatever its id: of a group one row stays, with the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hubwright.llm.exact_dedup import unique_rows
from hubwright.llm.packing import pack_documents
from hubwright.llm.quality import fit
from hubwright.llm.secret_scan import redact
from hubwright.llm.simhash import one_of_each
from hubwright.session import delete_folder, scratch, staged_path


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.where(fit(docs, ["doc_id"]).keeps(F.col("text")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unique_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each SimHash component, by the operator's own shingles and bits."""
    return one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: The classifier, near duplicates and packing have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = staged_path(spark)
        with scratch(spark):  # what a stage has staged goes once its output is written
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
