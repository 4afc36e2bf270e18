"""A sketch kept up to date by a Structured Streaming query.

Each micro-batch is sketched like a batch input and merged into the cells of
the batch before. The cells go to two slots in turn: batch b reads slot
(b-1) mod 2 and overwrites slot b mod 2, so a batch that is retried after a
failure finds its input untouched and is counted once. The state is the sketch,
whose size is bounded by its parameters, however long the stream runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from merscope.operators.sketch import CELL_COLUMNS, CELL_SCHEMA, SketchParams, merge_cells
from merscope.plans.histogram import kmer_cells
from merscope.sources.fasta import fasta_lines, fasta_sequences
from merscope.sources.fastq import RECORD_START, fastq_sequences
from merscope.sources.reads import SUFFIXES
from merscope.sources.spread import spread

STATE_SCHEMA = f"{CELL_SCHEMA}, batch bigint"


def slot(state: str, batch_id: int) -> str:
    return f"{state}/slot={batch_id % 2}"


def read_slot(spark: SparkSession, state: str, batch_id: int) -> DataFrame:
    return spark.read.schema(STATE_SCHEMA).parquet(slot(state, batch_id))


def check_label(cells: DataFrame, batch_id: int) -> None:
    """A slot must hold the batch it is read for; one without cells tells nothing."""
    found = cells.agg(F.min("batch"), F.max("batch")).first()
    if any(label is not None and label != batch_id for label in found):
        raise ValueError(f"the state holds batch {found[1]} where batch {batch_id} was expected")


def state_parameters(spark: SparkSession, state: str, k: int, params: SketchParams) -> None:
    """Note beside the slots what they are sketches of; refuse anything else later.

    Cells of another k, hash, seed or size would merge without a word.
    """
    now = {"k": k, **asdict(params)}
    schema = "k int, r_exp int, u_exp int, copies int, seed bigint, hash string"
    try:
        noted = spark.read.schema(schema).json(f"{state}/params").first()
    except AnalysisException:
        noted = None
    if noted is None:
        spark.createDataFrame([now], schema).coalesce(1).write.mode("overwrite").json(f"{state}/params")
    elif noted.asDict() != now:
        raise ValueError(f"{state} holds a sketch of {noted.asDict()}, not of {now}")


def start_sketch_stream(
    stream: DataFrame,
    state: str,
    checkpoint: str,
    k: int = 21,
    params: SketchParams = SketchParams(),
    *,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    preaggregate: bool = False,
) -> StreamingQuery:
    """Sketch a streaming DataFrame with a ``seq`` column until it ends.

    ``state`` and ``checkpoint`` must be folders all executors can reach.
    ``prepare`` turns a micro-batch into such a DataFrame where that takes
    operators a stream does not have. The query stops when all data available
    at its start is in; starting it again continues from there.
    """

    state_parameters(stream.sparkSession, state, k, params)

    def update(batch: DataFrame, batch_id: int) -> None:
        reads = prepare(batch) if prepare else spread(batch)
        cells = kmer_cells(reads, k, params, preaggregate=preaggregate)
        if batch_id > 0:
            before = read_slot(batch.sparkSession, state, batch_id - 1)
            check_label(before, batch_id - 1)
            cells = merge_cells(before, cells)
        labelled = cells.withColumn("batch", F.lit(batch_id).cast("bigint"))
        labelled.write.mode("overwrite").parquet(slot(state, batch_id))

    return (
        stream.writeStream.foreachBatch(update)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_cells(spark: SparkSession, state: str) -> DataFrame:
    """Cells after the last finished batch."""
    newest, cells = -1, spark.createDataFrame([], CELL_SCHEMA)
    for number in (0, 1):
        try:
            found = read_slot(spark, state, number)
        except AnalysisException:
            continue
        batch = found.agg(F.max("batch")).first()[0]
        if batch is not None and batch > newest:
            newest, cells = batch, found.select(*CELL_COLUMNS)
    return cells


def start_file_stream(
    spark: SparkSession,
    folder: str,
    format: str,
    state: str,
    checkpoint: str,
    k: int = 21,
    params: SketchParams = SketchParams(),
    *,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Sketch the FASTA or FASTQ files that have arrived in ``folder``."""
    if format not in SUFFIXES:
        raise ValueError(f"format must be one of {sorted(SUFFIXES)}")
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    if format == "fastq":
        raw = reader.text(folder, lineSep=RECORD_START)
        stream = fastq_sequences(raw.select("value", F.col("_metadata.file_path").alias("file")))
        prepare = None
    else:
        stream = fasta_lines(reader.text(folder))
        prepare = lambda lines: fasta_sequences(lines, k)
    return start_sketch_stream(
        stream, state, checkpoint, k, params, prepare=prepare
    )
