"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from merscope.plans.scratch import scratch_dir


def saved(rows: DataFrame) -> DataFrame:
    """The rows, written once and read back: later uses neither recompute them nor need their lineage."""
    path = scratch_dir(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
