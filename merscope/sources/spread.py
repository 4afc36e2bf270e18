"""Spreading rows that arrive in too few or too uneven input splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GZIP = ".gz"

# Splits beyond so many are read several a task, as long as a task reads no more than this.
TASKS = 256
TASK_BYTES = 64 << 20

# File names that end in .gz, and all others, as Hadoop globs.
GZIP_NAMES = f"*{GZIP}"
OTHER_NAMES = "{?,*[^z],*[^g]z,*[^.]gz}"


def spread(scan: DataFrame, splits: int | None = None) -> DataFrame:
    """Deal the rows of a scan out over the cluster if it has fewer splits than cores.

    Rows are dealt round-robin, so no value of theirs can make a partition
    hot. Any other scan is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan.rdd.getNumPartitions() if splits is None else splits
    return scan.repartition(cores) if splits < cores else scan


def spread_gzip(scan: DataFrame) -> DataFrame:
    """Deal out the rows of gzip files, each of which is one split however large.

    The number of partitions follows from the bytes that arrive, by Spark's
    advisory partition size; it is not tied to the number of files.
    """
    return scan.hint("rebalance")


def tasks_of(spark: SparkSession, splits: int) -> int:
    """How many tasks read so many input splits of files: however small these are, tasks do not outgrow the bytes."""
    most = splits * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return min(splits, max(TASKS, 4 * spark.sparkContext.defaultParallelism, -(-most // TASK_BYTES)))
