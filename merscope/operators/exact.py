"""Exact k-mer counts and abundance histogram."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merscope.functions.bases import decode_words, word_names, word_spans


def kmer_counts(kmers: DataFrame) -> DataFrame:
    """Occurrences ``cnt`` of each distinct k-mer.

    A plain grouped count: Spark combines map-side first, so a k-mer that makes
    up a third of the input reaches the shuffle as one row per task.
    """
    return kmers.groupBy(*kmers.columns).agg(F.count(F.lit(1)).alias("cnt"))


def check_n(n: int) -> int:
    if not isinstance(n, int) or n < 0:
        raise ValueError(f"n must be an integer >= 0, got {n!r}")
    return n


def abundance_histogram(counts: DataFrame, n: int) -> DataFrame:
    """``histogram(i, est)`` with exactly the rows i = 0..n, zeros included.

    Multiplicities above n share one bucket before they are grouped, so the
    second shuffle moves at most n+1 rows per task.
    """
    check_n(n)
    capped = F.least(F.col("cnt"), F.lit(n + 1).cast("bigint"))
    buckets = counts.groupBy(capped.alias("v")).agg(F.count(F.lit(1)).alias("m"))
    both = F.explode(F.array(F.lit(0).cast("bigint"), F.col("v")))
    rows = buckets.select(both.alias("i"), F.col("m").alias("est"))
    zero = F.lit(0).cast("bigint").alias("est")
    zeros = counts.sparkSession.range(n + 1).select(F.col("id").alias("i"), zero)
    return (
        rows.unionByName(zeros)
        .where(F.col("i") <= n)
        .groupBy("i")
        .agg(F.sum("est").alias("est"))
    )


def distinct_kmers(kmers: DataFrame) -> DataFrame:
    """Exact F0 as one row."""
    return kmers.distinct().agg(F.count(F.lit(1)).alias("f0"))


def ends_by_prefix(counts: DataFrame, k: int, bases: int) -> DataFrame:
    """``(prefix, kmers, cnt, first_kmer, last_kmer)`` of packed counts by their leading bases, a row a prefix and task.

    The least and the greatest of strings would have Spark sort all of them;
    here a task keeps the two of each prefix, packed, and spells out only these.
    """
    names, width = word_names(k), len(word_names(k))
    start, stop = word_spans(k)[0]
    shift = 2 * (stop - start - bases)

    def reduced(rows: list[np.ndarray]) -> list[np.ndarray]:
        """First and last row of each prefix; the first has the totals, the last none."""
        order = np.lexsort(rows[:width][::-1])
        rows = [r[order] for r in rows]
        prefix = rows[0] >> shift
        begins = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
        ends = np.append(begins[1:], len(prefix)) - 1
        none = np.zeros(len(ends), np.int64)
        totals = [np.add.reduceat(r, begins) for r in rows[width:]]
        return [np.concatenate([r[begins], r[ends]]) for r in rows[:width]] + [np.concatenate([t, none]) for t in totals]

    def ends_of(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                *words, cnt = (c.to_numpy() for c in batch.columns)
                rows = [*words, np.ones(len(cnt), np.int64), cnt]
                held = reduced(rows if held is None else [np.concatenate(pair) for pair in zip(held, rows)])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in held], [*names, "kmers", "cnt"])

    schema = ", ".join(f"{name} bigint" for name in [*names, "kmers", "cnt"])
    found = counts.select(*names, "cnt").mapInArrow(ends_of, schema).select(decode_words(k).alias("kmer"), "kmers", "cnt")
    return found.select(
        F.substring("kmer", 1, bases).alias("prefix"), "kmers", "cnt", F.col("kmer").alias("first_kmer"), F.col("kmer").alias("last_kmer")
    )
