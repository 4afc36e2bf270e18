"""A fresh folder for files a query has to write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the shared folder the session names for checkpoints.

    Only where driver and executors are one process may that setting be
    missing; the path is then on the local disk. On a cluster each executor
    would write to its own disk, so that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="merscope-")
    return f"{shared}/merscope-{uuid.uuid4().hex}"
