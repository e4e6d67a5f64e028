"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

# Runtime SQL settings for skewed joins and right-sized shuffle partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even where that costs one more shuffle afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(name: str = "hubwright", cores: int | str = "*", shuffle_partitions: int = 8, conf: dict[str, str] | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", "12g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in {**RECOMMENDED_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    Taken from ``spark.checkpoint.dir``. Only a local session may do without:
    on a cluster a folder of one machine would not outlive that machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hubwright-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder and go on from there.

    Iterative operators call this once per round, so that the plan does not
    grow and a lost executor never sends the job back to the first round.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the frame has at most ``most`` rows; else leave the choice to Spark.

    Give it a frame that was written before, or counting computes it once more.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Buckets may be small while there are no more than so many: each is a file per write, and a file takes its time whatever it holds.
SMALL_BUCKETS = 64


def bucket_count(rows: int, wanted: int, full: int) -> int:
    """Buckets of ``wanted`` rows; where that makes more than ``SMALL_BUCKETS``, so many, or as many as hold ``full`` rows each."""
    return max(1, min(-(-rows // wanted), max(SMALL_BUCKETS, -(-rows // full))))


#: The folder that ``scratch`` has opened in a thread. A stream's batches run in a thread of their own, and what other threads
#: stage meanwhile is not theirs to remove.
_SCRATCH = threading.local()


def _staging(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def delete_folder(spark: SparkSession, folder: str) -> bool:
    """Remove a folder in whatever store it lies; whether it was there."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Remove what this application has staged. Call it when no result that reads it is needed any more."""
    delete_folder(spark, _staging(spark))


def staged_path(spark: SparkSession) -> str:
    """A new name below the staging folder, for files that live no longer than the application."""
    return f"{getattr(_SCRATCH, 'folder', None) or _staging(spark)}/{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is removed at the end: write the result to a path made before."""
    outer, folder = getattr(_SCRATCH, "folder", None), staged_path(spark)
    _SCRATCH.folder = folder
    try:
        yield
    finally:
        _SCRATCH.folder = outer
        delete_folder(spark, folder)


def stage_table(df: DataFrame) -> DataFrame:
    """Write the frame as Parquet into the checkpoint folder and read it from there.

    For wide rows that several later steps each need a few columns of.
    """
    path = staged_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
