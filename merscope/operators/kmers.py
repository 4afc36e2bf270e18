"""Canonical k-mers of a DataFrame of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merscope.functions.bases import reverse_complement, word_names
from merscope.operators.packing import bin_batches, count_batches, count_runs, kmer_batches, merge_bins, run_batches
from merscope.operators.segments import check_k, segments, tile_sequences

# Tile for the string form: substring on a string walks it from the start.
STRING_TILE = 256

# Up to so many words, a task counts in an array with a place for each.
FEW_KMERS = 1 << 22

# From so many bases on, k-mers are dealt out in the runs they come in: by their smallest word of MINIMIZER bases.
IN_RUNS = 48
MINIMIZER = 15


def canonical_kmers(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """One row per k-mer occurrence, packed in BIGINT columns.

    Up to 31 bases fit the single column ``kmer``; longer k-mers take
    ``kmer_0, kmer_1, ...`` with the leading bases first. The step is narrow
    (no shuffle) and reads only the sequence column.
    """
    check_k(k)
    schema = ", ".join(f"{name} bigint" for name in word_names(k))
    return ended_tiles(reads, k, seq).mapInArrow(kmer_batches(k), schema)


def ended_tiles(reads: DataFrame, k: int, seq: str) -> DataFrame:
    return tile_sequences(reads, k, seq).select(F.concat("tile", F.lit(b"\n")).alias("tile"))


def counted_kmers(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """The distinct k-mers of :func:`canonical_kmers` and their occurrences ``cnt``.

    K-mers are counted in the tasks before they get to Spark, in an array with
    a place for each if there are few of that length, so that a row is made for
    each that a task has seen and not for each occurrence. Others go in packed
    arrays, see :func:`counted_in_bins`. Long ones overlap in nearly all of their
    bases, and are moved together: see :func:`counted_in_runs`.
    """
    if check_k(k) >= IN_RUNS:
        return counted_in_runs(reads, k, seq)
    if 4**k > FEW_KMERS:
        return counted_in_bins(reads, k, seq)
    counts = ended_tiles(reads, k, seq).mapInArrow(count_batches(k), "kmer bigint, cnt bigint")
    return counts.groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def counted_in_bins(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """The same for k-mers of any length, moved as packed arrays of distinct ones.

    A task reduces what it has gathered to distinct k-mers and counts and sends
    them in rows of many, by bins of their hash, which are merged where they
    arrive. A k-mer that makes up a third of the input is one number a task.
    """
    found = ended_tiles(reads, k, seq).mapInArrow(bin_batches(k), "bin int, kmers binary, cnt binary")
    schema = ", ".join(f"{name} bigint" for name in [*word_names(k), "cnt"])
    return found.repartition("bin").sortWithinPartitions("bin").mapInArrow(merge_bins(k), schema)


def counted_in_runs(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """The same for k-mers above ``MINIMIZER`` bases, moved as runs of bases and not one by one.

    Consecutive windows that share the smallest of their m-mers are one row. All
    occurrences of a k-mer have that m-mer too, so that the rows dealt out by
    it are spelled out and counted where they arrive, with no other shuffle. A
    task holds the runs of one m-mer at a time, not its k-mers.
    """
    runs = ended_tiles(reads, k, seq).mapInArrow(run_batches(k, MINIMIZER), "bin int, run binary")
    schema = ", ".join(f"{name} bigint" for name in [*word_names(k), "cnt"])
    return runs.repartition("bin").sortWithinPartitions("bin").mapInArrow(count_runs(k), schema)


def canonical_kmer_strings(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """The same rows as one STRING column ``kmer``, from built-ins alone.

    The reverse complement is taken once per segment; the reverse complement
    of the k-mer at position p then starts at L - p - k + 2.
    """
    check_k(k)
    tiles = tile_sequences(reads, k, seq, tile=STRING_TILE)
    runs = segments(tiles.select(F.col("tile").cast("string").alias("seq")), k)
    at = F.col("p")
    other = F.length("segment") - at - F.lit(k - 2)
    return runs.select(
        "segment",
        reverse_complement(F.col("segment")).alias("rc"),
        F.explode(F.sequence(F.lit(1), F.length("segment") - F.lit(k - 1))).alias("p"),
    ).select(
        F.least(
            F.substring("segment", at, F.lit(k)), F.substring("rc", other, F.lit(k))
        ).alias("kmer")
    )
