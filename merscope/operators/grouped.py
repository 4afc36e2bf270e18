"""Sketches by group: the abundance histogram of every file, sample or lane in one pass.

A sketch is kept for each value of a group column, as blocks with that column
in front. Blocks of finer groups merge into those of coarser ones, so that one
pass over the reads serves every level of a hierarchy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merscope.operators.blocks import (
    MOST_BYTES,
    TaskSketch,
    block_level_histogram,
    check_family,
    in_batches,
    merge_blocks,
    schema_by,
)
from merscope.operators.estimate import check_frequencies, histogram_from_levels
from merscope.operators.packing import base_codes, gathered_kmers
from merscope.operators.segments import check_k, tile_sequences
from merscope.operators.sketch import SketchParams

GROUP = "grp"
# Groups a task keeps at a time; it sends their blocks when there are more.
MOST_GROUPS = 256


def grouped_blocks(reads: DataFrame, group: Column, k: int, params: SketchParams, seq: str = "seq") -> DataFrame:
    """Merged blocks ``(grp, copy, level, part, ...)``: one sketch for each value of ``group``.

    Null groups are one group. A group that holds most of the reads is
    combined in the tasks like a whole sketch.
    """
    check_k(k)
    check_family(params)
    table = base_codes()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str | None, TaskSketch] = {}

        def rows() -> Iterator[tuple]:
            for name, held in own.items():
                yield from ((name, *row) for row in held.rows())

        for batch in batches:
            coded = batch.column(0).dictionary_encode("encode")
            indices, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            for at in np.unique(indices).tolist():
                tiles = batch.column(1).take(pa.array(np.flatnonzero(indices == at)))
                held = own.setdefault(names[at], TaskSketch(params))
                for words in gathered_kmers(tiles, k, table):
                    held.add(words)
            if len(own) > MOST_GROUPS or sum(s.size() for s in own.values()) > MOST_BYTES or any(s.should_send() for s in own.values()):
                yield from in_batches(rows(), (GROUP,))
                own = {}
        yield from in_batches(rows(), (GROUP,))

    named = reads.select(group.cast("string").alias(GROUP), F.col(seq).alias("seq"))
    tiles = tile_sequences(named, k, keep=(GROUP,)).select(GROUP, F.concat("tile", F.lit(b"\n")).alias("tile"))
    return merge_blocks(tiles.mapInArrow(sketch, schema_by((GROUP,))), params, (GROUP,))


def rolled_up(blocks: DataFrame, coarser: Column, params: SketchParams) -> DataFrame:
    """Sketches of coarser groups from those of finer ones; ``coarser`` is made of the column ``grp``."""
    return merge_blocks(blocks.withColumn(GROUP, coarser.cast("string")), params, (GROUP,))


def grouped_histogram(blocks: DataFrame, params: SketchParams, n: int = 8) -> DataFrame:
    """``(grp, i, est)`` with the rows i = 0..n of every group that has a k-mer."""
    check_frequencies(n)
    return histogram_from_levels(block_level_histogram(blocks, params, n, (GROUP,)), params, n, (GROUP,))
