"""The data source, and streams with keyed state."""

import gzip
import os
import random
from collections import Counter

import pytest
from kmer_cases import brute_kmers, estimates, frame, random_seqs
from pyspark.sql import functions as F

from merscope import kmer_histogram, read_sequences
from merscope.functions.bases import decode_words
from merscope.operators.kmers import canonical_kmers
from merscope.operators.sketch import SketchParams
from merscope.sources import datasource
from merscope.sources.reads import read_ranges
from merscope.streaming.state_stream import start_file_state_stream, start_state_stream, state_blocks, state_histogram

RNG = random.Random(61)
PARAMS = SketchParams(r_exp=8, copies=3)


def kmers_of(reads, k):
    rows = canonical_kmers(reads, k).select(decode_words(k).alias("kmer"))
    return {r["kmer"]: r["n"] for r in rows.groupBy("kmer").agg(F.count("*").alias("n")).collect()}


def fasta(seqs, width=50):
    return "".join(">s\n" + "\n".join(s[i : i + width] for i in range(0, len(s), width)) + "\n" for s in seqs)


def fastq(seqs):
    return "".join(f"@r\n{s}\n+\n{'@' * len(s)}\n" for s in seqs)


@pytest.mark.parametrize("split", [100, 1 << 20])
def test_files_of_all_kinds(spark, tmp_path, split):
    a, b, c, d = (random_seqs(RNG, 20, 5, 200, "ACGTN") for _ in range(4))
    (tmp_path / "a.fa").write_text(fasta(a))
    (tmp_path / "b.fastq").write_text(fastq(b))
    (tmp_path / "c.fa.gz").write_bytes(gzip.compress(fasta(c).encode()))
    (tmp_path / "d.fq.gz").write_bytes(b"".join(gzip.compress(fastq(d[i : i + 3]).encode()) for i in range(0, 20, 3)))
    (tmp_path / "_hidden.fa").write_text(">x\nACGT\n")
    paths = [str(tmp_path / n) for n in ("a.fa", "b.fastq", "*.gz")]
    reads = read_ranges(spark, paths, 9, split_bytes=split)
    assert reads.columns == ["file", "seq"]
    assert kmers_of(reads, 9) == brute_kmers(a + b + c + d, 9)
    assert {os.path.basename(r["file"]) for r in reads.select("file").distinct().collect()} == {"a.fa", "b.fastq", "c.fa.gz", "d.fq.gz"}
    if split == 100:
        assert reads.rdd.getNumPartitions() > 60


def test_by_format_name(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part-1").write_text(fastq(["ACGTA", "GGGTC"]))
    (tmp_path / "in" / "part-2.gz").write_text(fastq(["TTTTA"]))
    datasource.register(spark)
    reads = spark.read.format("merscope").option("format", "fastq").option("k", 3).load(str(tmp_path / "in"))
    assert sorted(r["seq"] for r in reads.collect()) == ["ACGTA", "GGGTC", "TTTTA"]
    assert read_sequences(spark, str(tmp_path / "in"), 3, "fastq", reader="auto").count() == 3


def test_what_is_wrong_is_said(spark, tmp_path):
    for options in ({"k": "0"}, {"k": "3", "format": "sam"}):
        with pytest.raises(Exception, match="positive|must be one of"):
            datasource.SequenceReader({"path": str(tmp_path), **options})
    with pytest.raises(Exception, match="no such file"):
        read_ranges(spark, [str(tmp_path / "none.fq")], 3).count()
    with pytest.raises(ValueError):
        read_sequences(spark, str(tmp_path), 3, "fastq", reader="guess")
    (tmp_path / "bad.fq").write_text("@a\nACGT\nACGT\n+\nIIII\nIIII\n")
    with pytest.raises(Exception, match="FASTQ record without"):
        read_ranges(spark, [str(tmp_path / "bad.fq")], 3).collect()


def test_empty_folder_and_files(spark, tmp_path):
    assert read_ranges(spark, [str(tmp_path)], 3, "fastq").count() == 0
    (tmp_path / "a.fq").write_text("")
    assert read_ranges(spark, [str(tmp_path / "a.fq")], 3).count() == 0


def test_fasta_is_read_once_without_a_shuffle(spark, tmp_path):
    seq = "".join(RNG.choices("ACGT", k=40_000))
    (tmp_path / "a.fa").write_text(fasta([seq], 10**9))
    reads = read_ranges(spark, [str(tmp_path / "a.fa")], 21, split_bytes=3000)
    plan = canonical_kmers(reads, 21)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("BatchScan") == 1
    assert canonical_kmers(reads, 21).count() == 40_000 - 20


@pytest.mark.parametrize("kind", ["fasta", "fastq"])
def test_stream_of_files_equals_batch_over_restarts(spark, tmp_path, kind):
    seqs = random_seqs(RNG, 90, 20, 120)
    inbox, folder = tmp_path / "in", str(tmp_path / "state")
    inbox.mkdir()
    text = fasta if kind == "fasta" else fastq
    for step, part in enumerate((seqs[:40], seqs[40:])):
        for i in range(2):
            (inbox / f"{step}-{i}.txt").write_text(text(part[i::2]))
        start_file_state_stream(spark, str(inbox), kind, folder, 13, PARAMS, files_per_batch=1, split_bytes=700).awaitTermination()
    want = estimates(kmer_histogram(frame(spark, seqs), 13, 4, r_exp=8, copies=3))
    assert estimates(state_histogram(spark, folder, PARAMS, 4).orderBy("i")) == want


def test_a_batch_writes_what_it_changed(spark, tmp_path):
    """A small batch after a large one touches few blocks and leaves the others' state as it is."""
    inbox, folder = str(tmp_path / "in"), str(tmp_path / "state")
    params = SketchParams(r_exp=12, copies=1)

    def run():
        stream = spark.readStream.schema("seq string").parquet(inbox)
        query = start_state_stream(stream, folder, 21, params)
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsUpdated"] for p in map(dict, query.recentProgress) if p["stateOperators"]]

    frame(spark, random_seqs(RNG, 300, 90, 90)).write.parquet(inbox)
    first = sum(run())
    frame(spark, ["ACGTTGCAATCCGATTACAGG"]).write.mode("append").parquet(inbox)
    second = sum(run())
    assert second == 1 and first > 8
    assert state_blocks(spark, folder).count() >= first


def test_another_seed_is_refused(spark, tmp_path):
    inbox, folder = tmp_path / "in", str(tmp_path / "state")
    inbox.mkdir()
    (inbox / "a").write_text(fastq(["ACGTACGTTT"]))
    start_file_state_stream(spark, str(inbox), "fastq", folder, 7, PARAMS).awaitTermination()
    with pytest.raises(ValueError):
        start_file_state_stream(spark, str(inbox), "fastq", folder, 7, SketchParams(r_exp=8, copies=3, seed=4))


def test_gzip_members_are_read_by_several_tasks(spark, tmp_path):
    seqs = random_seqs(RNG, 400, 50, 80)
    data = b"".join(gzip.compress(fastq(seqs[i : i + 20]).encode()) for i in range(0, 400, 20))
    (tmp_path / "a.fq.gz").write_bytes(data)
    reads = read_ranges(spark, [str(tmp_path / "a.fq.gz")], 21, split_bytes=len(data) // 5)
    busy = reads.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(busy) >= 4 and Counter(r["seq"] for r in reads.collect()) == Counter(seqs)


@pytest.mark.parametrize("kind", ["fasta", "fastq"])
def test_tasks_do_not_outgrow_the_input_however_small_the_ranges(spark, tmp_path, kind):
    seqs = random_seqs(RNG, 300, 50, 150)
    for name, some in (("a", seqs[:100]), ("b", seqs[100:])):
        (tmp_path / name).write_text(fasta(some) if kind == "fasta" else fastq(some))
    reads = read_ranges(spark, [str(tmp_path)], 9, kind, split_bytes=40)
    assert 100 < reads.rdd.getNumPartitions() <= datasource.TASKS
    assert kmers_of(reads, 9) == brute_kmers(seqs, 9)


def test_little_is_read_behind_a_range(tmp_path):
    from io import BytesIO

    from merscope.sources import ranges

    class Counted(BytesIO):
        taken = 0

        def read(self, size=-1):
            data = super().read(size)
            self.taken += len(data)
            return data

    text = fastq(random_seqs(RNG, 40_000, 60, 60)).encode()
    file = Counted(text)
    found = [s for part in ranges.fastq_range(file, 500_000, 510_000, "x") for s in part]
    assert found and file.taken < 60_000
