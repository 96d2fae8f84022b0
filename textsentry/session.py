"""Session-level helpers: size checks, input spreading and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Whether the shuffle files of a query go when it ends, not when the driver happens to collect garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Largest estimated size of a side that may be broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df``; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimate is under ``limit``; otherwise leave the join to AQE."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Repartition a table whose scan yields fewer splits than there are cores.

    Regex matching is CPU-bound, so one parquet row group on one core is the
    bottleneck for small tables. A table with a split per core is left alone,
    whatever its size: shuffling whole texts would cost more than it gains.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString():  # planning it would run it
        return df
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df


def work_root(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder of its own; a
    cluster session without it is an error, because executors cannot see one
    another's disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="textsentry-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below :func:`work_root`."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Several consumers of one scan read the written table, and a lost executor
    costs a re-read, not a re-scan. Nothing reads the shuffles behind it again, so
    their files go at once: steps in a row need the disk of the largest one.
    """
    spark = df.sparkSession
    path, before = work_path(spark, name), spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
