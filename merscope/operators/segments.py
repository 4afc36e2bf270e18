"""From sequences to segments and bounded tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merscope.functions.bases import NON_BASES, normalise

# Bases per tile. Small enough that an Arrow batch of 10,000 tiles stays under
# 100 MB, large enough that the k-1 overlap costs next to nothing.
TILE = 8192


def check_k(k: int) -> int:
    if not isinstance(k, int) or k < 1:
        raise ValueError(f"k must be a positive integer, got {k!r}")
    return k


def byte_slices(raw: Column, step: int, width: int, spare: int) -> Column:
    """Array of the slices of ``raw`` that begin at every multiple of ``step``.

    Slices are ``width`` bytes long; none begins in the last ``spare`` bytes. A
    value no longer than ``width`` stays whole. The bytes are handed to the
    inner function as a lambda variable: naming the column there would copy
    the whole value once per slice.
    """
    last = F.floor((F.length(raw) - F.lit(spare + 1)) / F.lit(step)).cast("int")
    starts = F.sequence(F.lit(0), last)
    cuts = F.transform(
        F.array(raw),
        lambda all_: F.transform(
            starts, lambda i: F.substring(all_, i * F.lit(step) + F.lit(1), F.lit(width))
        ),
    )
    return F.when(F.length(raw) <= width, F.array(raw)).otherwise(F.flatten(cuts))


def tile_sequences(reads: DataFrame, k: int, seq: str = "seq", tile: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cut long sequences into binary tiles that overlap by k-1 bytes.

    Every window of k bytes lies in exactly one tile as a window start, so the
    k-mers of the tiles are the k-mers of the sequences, each exactly once. A
    chromosome-length row thus becomes many small rows that Spark can spread.
    Slicing bytes instead of characters keeps each cut O(tile) and is exact: a
    k-mer is pure ASCII, so a cut inside a wider character only yields bytes
    that end a segment anyway.

    Sequences shorter than k pass through: filtering them here would have Spark
    evaluate the sequence twice, and below any shuffle that feeds it. The
    columns ``keep`` stay with the tiles.
    """
    tile = max(tile or TILE, k)
    source = reads.select(*keep, F.col(seq).cast("binary").alias("raw"))
    return source.select(*keep, F.explode(byte_slices(F.col("raw"), tile, tile + k - 1, k - 1)).alias("tile"))


def segments(reads: DataFrame, k: int = 1, seq: str = "seq") -> DataFrame:
    """Maximal runs of A/C/G/T of at least k bases, one row ``segment`` each.

    Ambiguity codes, gaps, digits and any other byte end a segment; lower-case
    bases are folded first.
    """
    pieces = F.explode(F.split(normalise(F.col(seq)), NON_BASES))
    return reads.select(pieces.alias("segment")).where(F.length("segment") >= k)
