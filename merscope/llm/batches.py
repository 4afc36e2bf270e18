"""Memory bounds for Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
# A worker holds a batch as Arrow, as Python objects and as what is made of them.
MOST_BYTES = 4 << 20


def bound_batches(spark: SparkSession, most: int = MOST_BYTES) -> None:
    """Bound Arrow batches by bytes, so that long texts come in smaller batches.

    A smaller bound that the session already has stays.
    """
    now = spark.conf.get(SETTING, None)
    if now is None or not now.isdigit() or int(now) > most:
        spark.conf.set(SETTING, str(most))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounded Arrow batches for the jobs that are run inside; the session's own bound comes back."""
    before = spark.conf.get(SETTING, None)
    bound_batches(spark)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SETTING)
        else:
            spark.conf.set(SETTING, before)


def give_back() -> None:
    """Give the system what Arrow and the C library have freed and kept."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frees_memory(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A step on Arrow batches that gives back what is freed at its end, as workers wait for later tasks."""

    @wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        give_back()

    return run
