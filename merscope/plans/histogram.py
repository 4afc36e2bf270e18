"""The query: reads in, abundance histogram out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from merscope.functions.bases import decode_words
from merscope.functions.hash_arrays import ARRAY_FAMILIES
from merscope.operators.blocks import (
    block_level_histogram,
    blocks_of_counts,
    blocks_of_reads,
    full_pairs,
    marked_blocks,
    md5_cells_of_reads,
    merge_blocks,
)
from merscope.operators.estimate import check_frequencies, histogram_from_levels, level_histogram
from merscope.operators.exact import abundance_histogram, check_n
from merscope.operators.kmers import FEW_KMERS, canonical_kmers, counted_kmers
from merscope.operators.segments import check_k
from merscope.operators.sketch import SketchParams, full_levels, marks, merge_cells, sketch_cells
from merscope.plans.telemetry import RunCounts
from merscope.sources.reads import read_sequences

METHODS = ("sketch", "exact")


def counts_to_sketch(reads: DataFrame, k: int, params: SketchParams, seq: str = "seq") -> DataFrame:
    """Distinct k-mers with their counts ``cnt``, in the form that the hash takes.

    They are counted packed; only the distinct ones are spelled out.
    """
    counts = counted_kmers(reads, k, seq)
    return counts.select(decode_words(k).alias("kmer"), "cnt") if params.hash == "md5" else counts


def kmer_cells(
    reads: DataFrame,
    k: int = 21,
    params: SketchParams = SketchParams(),
    *,
    seq: str = "seq",
    prove_with: DataFrame | None = None,
    preaggregate: bool = False,
) -> DataFrame:
    """Sketch cells of the canonical k-mers of ``reads``, one row a cell.

    ``prove_with`` is a part of the reads, e.g. a few of many files. It is
    sketched first; levels it fills up altogether, which no estimate can come
    from, are then left out for the whole and marked as full. Estimates, and
    merges with any other sketch, are the same with and without it; on a large
    input it leaves a few k-mers in a million to shuffle. ``preaggregate``
    counts distinct k-mers before sketching; it pays where each k-mer is seen
    many times and fits a shuffle, and is done in any case where there are no
    more than ``FEW_KMERS`` different k-mers of that length.
    """
    counted = preaggregate or 4**k <= FEW_KMERS

    def cells(rows: DataFrame, full: list[tuple[int, int]]) -> DataFrame:
        if counted:
            return sketch_cells(counts_to_sketch(rows, k, params, seq), params, full, weight="cnt")
        if params.hash == "md5":
            found = merge_cells(md5_cells_of_reads(rows, k, params, seq, full))
            return found.unionByName(marks(rows.sparkSession, full)) if full else found
        return sketch_cells(canonical_kmers(rows, k, seq), params, full)

    return cells(reads, [] if prove_with is None else full_levels(cells(prove_with, []), params))


def kmer_blocks(
    reads: DataFrame,
    k: int = 21,
    params: SketchParams = SketchParams(),
    *,
    seq: str = "seq",
    prove_with: DataFrame | None = None,
    preaggregate: bool = False,
) -> DataFrame:
    """The same sketch as merged blocks: see ``operators.blocks``. Options as for :func:`kmer_cells`."""
    full = []
    if prove_with is not None:
        full = full_pairs(merge_blocks(blocks_of_reads(prove_with, k, params, seq), params), params)
    if preaggregate:
        found = blocks_of_counts(counted_kmers(reads, k, seq), k, params, full=full)
    else:
        found = blocks_of_reads(reads, k, params, seq, full)
    if full:
        found = found.unionByName(marked_blocks(reads.sparkSession, full, params))
    return merge_blocks(found, params)


def kmer_histogram(
    reads: DataFrame,
    k: int = 21,
    n: int = 8,
    *,
    method: str = "sketch",
    seq: str = "seq",
    r_exp: int = 19,
    u_exp: int = 13,
    copies: int = 7,
    seed: int = 0,
    hash: str = "xxhash64",
    prove_with: DataFrame | None = None,
    preaggregate: bool = False,
    counts: RunCounts | None = None,
) -> DataFrame:
    """``histogram(i, est)`` ordered by i: F0 at i = 0, then f_1..f_n.

    Always n+1 rows, zeros included, also for an empty input. ``counts`` is
    told what the run has read.
    """
    check_k(k)
    reads = counts.watch(reads, seq) if counts else reads
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "exact":
        check_n(n)
        result = abundance_histogram(counted_kmers(reads, k, seq), n)
    else:
        check_frequencies(n)
        params = SketchParams(r_exp, u_exp, copies, seed, hash)
        options = {"seq": seq, "prove_with": prove_with, "preaggregate": preaggregate}
        if hash in ARRAY_FAMILIES:
            levels = block_level_histogram(kmer_blocks(reads, k, params, **options), params, n)
        else:
            levels = level_histogram(kmer_cells(reads, k, params, **options), params, n)
        result = histogram_from_levels(levels, params, n)
    return result.coalesce(1).orderBy("i")


def kmer_histogram_from_files(
    spark: SparkSession,
    paths: str | list[str],
    k: int = 21,
    n: int = 8,
    *,
    format: str | None = None,
    prove_files: int = 0,
    reader: str = "text",
    **options,
) -> DataFrame:
    """:func:`kmer_histogram` of FASTA/FASTQ files.

    The first ``prove_files`` paths are the part of :func:`kmer_cells`'s
    ``prove_with``: only they are read twice.
    """
    if prove_files and not isinstance(paths, str):
        options["prove_with"] = read_sequences(spark, list(paths)[:prove_files], k, format, reader=reader)
    return kmer_histogram(read_sequences(spark, paths, k, format, reader=reader), k, n, **options)
