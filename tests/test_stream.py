import random

import pytest
from kmer_cases import estimates, frame, random_seqs

from merscope.operators.estimate import histogram_from_cells
from merscope.operators.sketch import CELL_COLUMNS, SketchParams, merge_cells
from merscope.plans.histogram import kmer_cells
from merscope.sources.reads import read_sequences
from merscope.streaming.sketch_stream import (
    STATE_SCHEMA,
    check_label,
    read_slot,
    slot,
    start_file_stream,
    start_sketch_stream,
    stream_cells,
)

RNG = random.Random(23)
PARAMS = SketchParams(r_exp=8)


def rows(cells):
    return sorted(tuple(r) for r in cells.select(*CELL_COLUMNS).collect())


def write_files(folder, kind, seqs, parts):
    folder.mkdir(exist_ok=True)
    for i in range(parts):
        if kind == "fastq":
            text = "".join(f"@r\n{s}\n+\n{'@' * len(s)}\n" for s in seqs[i::parts])
        else:
            text = "".join(f">r\n{s[:31]}\n{s[31:]}\n" for s in seqs[i::parts])
        (folder / f"{kind}{len(list(folder.iterdir()))}.txt").write_text(text)


@pytest.mark.parametrize("kind", ["fastq", "fasta"])
def test_stream_of_files_equals_batch(spark, tmp_path, small_splits, kind):
    seqs = random_seqs(RNG, 160, 1, 90)
    inbox, state, progress = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "progress")
    small_splits(700)

    def run():
        query = start_file_stream(
            spark, str(inbox), kind, state, progress, 13, PARAMS, files_per_batch=1
        )
        query.awaitTermination()

    write_files(inbox, kind, seqs[:100], 3)
    run()
    write_files(inbox, kind, seqs[100:], 2)
    run()
    batch = kmer_cells(read_sequences(spark, str(inbox), 13, format=kind), 13, PARAMS)
    assert rows(stream_cells(spark, state)) == rows(batch)
    assert estimates(histogram_from_cells(stream_cells(spark, state), PARAMS, 3).orderBy("i")) == estimates(
        histogram_from_cells(batch, PARAMS, 3).orderBy("i")
    )


def test_a_repeated_batch_counts_once(spark, tmp_path):
    """The slot a batch reads is intact while it writes, so it can be redone."""
    state = str(tmp_path / "state")
    first = kmer_cells(frame(spark, ["ACGTTGCAAT" * 4]), 7, PARAMS)
    second = kmer_cells(frame(spark, ["GGATTCAGTA" * 4]), 7, PARAMS)

    def write(batch_id, cells):
        cells.selectExpr("*", f"{batch_id}L as batch").write.mode("overwrite").parquet(slot(state, batch_id))

    write(0, first)
    for _ in range(2):
        write(1, merge_cells(read_slot(spark, state, 0), second))
    assert rows(stream_cells(spark, state)) == rows(merge_cells(first, second))


def test_state_without_any_batch_is_empty(spark, tmp_path):
    assert stream_cells(spark, str(tmp_path / "none")).count() == 0


def test_any_streaming_frame_with_a_sequence_column(spark, tmp_path):
    seqs = random_seqs(RNG, 50, 20, 40)
    frame(spark, seqs).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = start_sketch_stream(
        stream, str(tmp_path / "s"), str(tmp_path / "p"), 33, PARAMS, preaggregate=True
    )
    query.awaitTermination()
    batch = kmer_cells(frame(spark, seqs), 33, PARAMS)
    assert rows(stream_cells(spark, str(tmp_path / "s"))) == rows(batch)


def test_another_k_or_seed_is_refused(spark, tmp_path):
    inbox, state, progress = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "progress")
    write_files(inbox, "fastq", random_seqs(RNG, 20, 30, 60), 2)
    start_file_stream(spark, str(inbox), "fastq", state, progress, 7, PARAMS).awaitTermination()
    for k, params in ((9, PARAMS), (7, SketchParams(r_exp=8, seed=5))):
        with pytest.raises(ValueError):
            start_file_stream(spark, str(inbox), "fastq", state, progress, k, params)
    start_file_stream(spark, str(inbox), "fastq", state, progress, 7, PARAMS).awaitTermination()


def test_a_slot_of_another_batch_is_refused(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1, 1, 1, 4)], STATE_SCHEMA)
    check_label(cells, 4)
    check_label(cells.where("false"), 9)
    with pytest.raises(ValueError):
        check_label(cells, 3)
