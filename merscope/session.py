"""Session used by the command line, the benchmark and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "merscope", master: str | None = None, **conf) -> SparkSession:
    """A session with the given settings; all others stay the cluster's own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
