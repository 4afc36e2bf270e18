"""A sketch kept in the state store of a Structured Streaming query.

The state is keyed by (copy, level, part): one block of the sketch a key, see
``operators.blocks``. A micro-batch is combined in its tasks like a batch
input; the blocks it touched meet their state, and only those are written by
the state store. Checkpoint and state are one thing, so a batch counts once
however often it is retried, and a restarted query goes on where it stopped.
The sketch is read from the state itself, at any finished batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from merscope.operators.blocks import BLOCK_NAMES, KEY, Block, block_level_histogram, blocks_of_reads, part_exp
from merscope.operators.estimate import check_frequencies, histogram_from_levels
from merscope.operators.sketch import SketchParams
from merscope.sources.datasource import SPLIT_BYTES, FileRange, range_batches
from merscope.sources.formats import SUFFIXES
from merscope.streaming.sketch_stream import state_parameters

STATE_SCHEMA = "full boolean, cols binary, low binary, high binary, cnt binary"
CHANGED_SCHEMA = "copy int, level int, part int, full boolean"
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def progress_folder(folder: str) -> str:
    return f"{folder}/progress"


def start_state_stream(
    stream: DataFrame, folder: str, k: int = 21, params: SketchParams = SketchParams(), seq: str = "seq"
) -> StreamingQuery:
    """Sketch a streaming DataFrame of sequences until all that is there at the start is in.

    ``folder`` takes the checkpoint with the state, and a note of k and the
    parameters; a query of others is refused.
    """
    state_parameters(stream.sparkSession, folder, k, params)
    size, u_exp = 1 << part_exp(params), params.u_exp

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block = Block(size, u_exp)
        if state.exists:
            block.merge(*state.get)
        for frame in frames:
            for row in zip(*(frame[name] for name in BLOCK_NAMES[3:])):
                block.merge(*row)
        copy, level, part, full, *arrays = block.row(*key)
        state.update((full, *arrays))
        yield pd.DataFrame({"copy": [copy], "level": [level], "part": [part], "full": [full]})

    changed = (
        blocks_of_reads(stream, k, params, seq)
        .groupBy(*KEY)
        .applyInPandasWithState(update, CHANGED_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)
    )
    return (
        changed.writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", progress_folder(folder))
        .trigger(availableNow=True)
        .start()
    )


def file_ranges(files: DataFrame, k: int, format: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(file, seq)`` of the files in ``(path, length)``, a batch or a stream of them.

    Their contents are read in ranges, which are dealt out over the cluster,
    by the readers of ``sources.ranges``; compressed FASTA is one range.
    """
    if format not in SUFFIXES:
        raise ValueError(f"format must be one of {sorted(SUFFIXES)}")
    one = F.col("path").endswith(".gz") if format == "fasta" else F.lit(False)
    step = F.when(one, F.col("length")).otherwise(F.lit(split_bytes).cast("bigint"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, step)
    begun = files.where("length > 0").select("path", "length", F.explode(starts).alias("start"))
    cut = begun.select("path", "start", F.least(F.col("length"), F.col("start") + step).alias("end"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                yield from range_batches(FileRange(path, format, start, end), k)

    return cut.repartition(files.sparkSession.sparkContext.defaultParallelism).mapInArrow(read, "file string, seq string")


def start_file_state_stream(
    spark: SparkSession,
    source: str,
    format: str,
    folder: str,
    k: int = 21,
    params: SketchParams = SketchParams(),
    *,
    files_per_batch: int = 1000,
    split_bytes: int = SPLIT_BYTES,
) -> StreamingQuery:
    """Sketch the FASTA or FASTQ files that have arrived in the folder ``source``.

    Spark follows the folder and gives the names; the contents are not read
    before they are cut into ranges.
    """
    found = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(source)
    return start_state_stream(file_ranges(found.select("path", "length"), k, format, split_bytes), folder, k, params)


def state_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks after the last finished batch, from the state store."""
    state = spark.read.format("statestore").load(progress_folder(folder))
    return state.select(*[F.col(f"key.{name}") for name in KEY], *[F.col(f"value.groupState.{name}") for name in BLOCK_NAMES[3:]])


def state_histogram(spark: SparkSession, folder: str, params: SketchParams, n: int = 8) -> DataFrame:
    """``histogram(i, est)`` of all that the stream has seen."""
    check_frequencies(n)
    return histogram_from_levels(block_level_histogram(state_blocks(spark, folder), params, n), params, n)
