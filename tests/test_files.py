import os
import gzip
import random
from collections import Counter

import pytest
from kmer_cases import brute_histogram, brute_kmers, estimates, frame, random_seqs
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from merscope import kmer_histogram_from_files, read_sequences
from merscope.functions.bases import decode_words
from merscope.operators.kmers import canonical_kmers
from merscope.sources.reads import file_format

RNG = random.Random(5)


def kmers_of(reads, k):
    rows = canonical_kmers(reads, k).select(decode_words(k).alias("kmer"))
    return {r["kmer"]: r["n"] for r in rows.groupBy("kmer").agg(F.count("*").alias("n")).collect()}


def fastq(records, newline="\n", plus="+"):
    """Records as (name, bases, quality)."""
    lines = []
    for name, seq, quality in records:
        lines += ["@" + name, seq, plus + (name if plus != "+" else ""), quality]
    return newline.join(lines) + newline


def quality_for(seq, rng):
    """Qualities that often begin with the characters that mark records."""
    return "".join(rng.choices("@+>I#ACGT", k=len(seq)))


def some_records(count, low=1, high=60):
    seqs = random_seqs(RNG, count, low, high, "ACGTACGTN")
    return [(f"r{i} x@y+z>w", s, quality_for(s, RNG)) for i, s in enumerate(seqs)]


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def wrap(seq, width, newline):
    return newline.join(seq[i : i + width] for i in range(0, len(seq), width))


# --- formats ------------------------------------------------------------------


@pytest.mark.parametrize(
    "name,kind",
    [("a.fa", "fasta"), ("a.fasta", "fasta"), ("a.fa.gz", "fasta"), ("a.b.fasta.gz", "fasta"),
     ("a.fq", "fastq"), ("a.fastq", "fastq"), ("a.fq.gz", "fastq"), ("x/*.fastq.gz", "fastq")],
)
def test_format_by_suffix(name, kind):
    assert file_format(name) == kind


@pytest.mark.parametrize("name", ["a.txt", "a.FA", "a.fq.bz2", "fa", "a.gz", "a.fa.gz.gz"])
def test_unknown_suffix(spark, name):
    with pytest.raises(ValueError, match="cannot tell the format"):
        read_sequences(spark, name, 3)


def test_missing_file_and_no_file(spark, tmp_path):
    with pytest.raises(AnalysisException):
        read_sequences(spark, str(tmp_path / "none.fq"), 3).count()
    with pytest.raises(ValueError):
        read_sequences(spark, [], 3)
    with pytest.raises(ValueError):
        read_sequences(spark, str(tmp_path), 3, format="sam")


# --- FASTQ --------------------------------------------------------------------


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("plus", ["+", "+same "])
def test_fastq(spark, tmp_path, newline, plus):
    records = some_records(200) + [("one", "A", "+"), ("two", "C", "@"), ("empty", "", ""), ("last", "GATTACA", "@@@@@@@")]
    path = write(tmp_path / "a.fq", fastq(records, newline, plus))
    got = Counter(r["seq"] for r in read_sequences(spark, path, 5).collect())
    assert got == Counter(seq for _, seq, _ in records)


def test_fastq_without_final_newline_or_cut_short(spark, tmp_path):
    text = fastq([("a", "ACGTA", "@IIII"), ("b", "GGGTA", "+IIII")])
    whole = brute_kmers(["ACGTA", "GGGTA"], 3)
    for i, cut in enumerate([text[:-1], text[:-6], text[:-7], text[:-8], text[:-9], text + "\n\n"]):
        path = write(tmp_path / f"{i}.fq", cut)
        assert kmers_of(read_sequences(spark, path, 3), 3) == whole, cut


@pytest.mark.parametrize("size", [1, 7, 31, 64, 100, 257, 1000, 4096])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_fastq_at_any_split_size(spark, tmp_path, small_splits, size, newline):
    records = some_records(25 if size < 50 else 120)
    path = write(tmp_path / "a.fastq", fastq(records, newline))
    small_splits(size)
    got = Counter(r["seq"] for r in read_sequences(spark, path, 5).collect())
    assert got == Counter(seq for _, seq, _ in records)


def test_fastq_over_several_lines_is_refused(spark, tmp_path):
    path = write(tmp_path / "a.fq", "@a\nACGT\nACGT\n+\nIIII\nIIII\n")
    with pytest.raises(Exception, match="FASTQ record without"):
        read_sequences(spark, path, 3).collect()


# --- FASTA --------------------------------------------------------------------


def fasta_bytes(seqs, width, newline):
    return "".join(
        f">s{i} has>another{newline}{wrap(s, width, newline)}{newline}" for i, s in enumerate(seqs)
    )


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("k", [1, 5, 40])
def test_fasta_wrapped(spark, tmp_path, newline, k):
    seqs = random_seqs(RNG, 60, 0, 300, "ACGTacgtNR-*")
    path = write(tmp_path / "a.fa", fasta_bytes(seqs, 23, newline))
    assert kmers_of(read_sequences(spark, path, k), k) == brute_kmers(seqs, k)


@pytest.mark.parametrize("text,seqs", [
    (">a\nACGT\nAC\n", ["ACGTAC"]),
    (">a\n\n\nACGT\n\nAC\n", ["ACGTAC"]),
    (">a\n>b\nACG\n>c\n", ["ACG"]),
    ("no header\nACGTA\n", ["ACGTA"]),
    ("\nACGTA\n", ["ACGTA"]),
    ("ACGTA", []),
    (">a\nACGTA>b\nCCG", ["ACGTA", "CCG"]),
    (">a\nAC@GTA+CCGGA\n", ["AC", "GTA", "CCGGA"]),
    (">a\nACNGTARYCCU GGA\n", ["AC", "GTA", "CC", "GGA"]),
    (">a\nac\ngt\n", ["ACGT"]),
    ("", []),
])
def test_fasta_cases(spark, tmp_path, text, seqs):
    path = write(tmp_path / "a.fasta", text)
    assert kmers_of(read_sequences(spark, path, 3), 3) == brute_kmers(seqs, 3)


@pytest.mark.parametrize("size", [1, 5, 16, 61, 200, 1000])
@pytest.mark.parametrize("k", [2, 9, 33])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_fasta_at_any_split_size(spark, tmp_path, small_splits, size, k, newline):
    scale = 1 if size < 16 else 5
    seqs = random_seqs(RNG, 8, 0, 60 * scale) + ["ACGT" * 10 * scale]
    path = write(tmp_path / "a.fa", fasta_bytes(seqs, 17, newline))
    small_splits(size)
    assert kmers_of(read_sequences(spark, path, k), k) == brute_kmers(seqs, k)


@pytest.mark.parametrize("width", [60, 10**9])
def test_fasta_chromosome(spark, tmp_path, small_splits, width):
    seqs = ["".join(RNG.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=300_000)), "ACGTT" * 3000]
    path = write(tmp_path / "a.fa", fasta_bytes(seqs, width, "\n"))
    small_splits(20_000)
    reads = read_sequences(spark, path, 21)
    assert kmers_of(reads, 21) == brute_kmers(seqs, 21)
    assert reads.agg(F.max(F.length("seq"))).first()[0] <= 8192 + 20


def test_fasta_long_header(spark, tmp_path):
    header = ">" + "ACGT" * 20_000
    path = write(tmp_path / "a.fa", f"{header}\nACGTA\n{header}\nGGGTT\n")
    assert kmers_of(read_sequences(spark, path, 5), 5) == brute_kmers(["ACGTA", "GGGTT"], 5)


def test_many_small_fasta_files(spark, tmp_path):
    seqs = random_seqs(RNG, 30, 1, 80)
    for i, s in enumerate(seqs):
        write(tmp_path / f"{i}.fa", f">x\n{wrap(s, 10, chr(10))}\n")
    assert kmers_of(read_sequences(spark, str(tmp_path / "*.fa"), 7), 7) == brute_kmers(seqs, 7)


# --- compression and several files -------------------------------------------------


def test_gzip_with_several_members(spark, tmp_path):
    first, second = some_records(40), some_records(30)
    data = b"".join(gzip.compress(fastq(r).encode()) for r in (first, second))
    (tmp_path / "a.fq.gz").write_bytes(data)
    got = Counter(r["seq"] for r in read_sequences(spark, str(tmp_path / "a.fq.gz"), 5).collect())
    assert got == Counter(s for _, s, _ in first + second)


def test_gzip_fasta(spark, tmp_path, small_splits):
    seqs = random_seqs(RNG, 50, 0, 300)
    (tmp_path / "a.fasta.gz").write_bytes(gzip.compress(fasta_bytes(seqs, 31, "\n").encode()))
    small_splits(200)
    assert kmers_of(read_sequences(spark, str(tmp_path / "a.fasta.gz"), 11), 11) == brute_kmers(seqs, 11)


def test_plain_content_under_a_gz_name(spark, tmp_path):
    records = some_records(10)
    path = write(tmp_path / "a.fq.gz", fastq(records))
    reads = read_sequences(spark, path, 5, compressed=False)
    assert Counter(r["seq"] for r in reads.collect()) == Counter(s for _, s, _ in records)


def test_mixed_files_are_parsed_each_by_its_suffix(spark, tmp_path):
    records, seqs, more = some_records(40), random_seqs(RNG, 20, 0, 100), some_records(10)
    paths = [
        write(tmp_path / "a.fa", fasta_bytes(seqs, 20, "\n")),
        write(tmp_path / "b.fq", fastq(records)),
        str(tmp_path / "c.fastq.gz"),
    ]
    (tmp_path / "c.fastq.gz").write_bytes(gzip.compress(fastq(more).encode()))
    bases = seqs + [s for _, s, _ in records + more]
    for order in (paths, paths[::-1]):
        got = estimates(kmer_histogram_from_files(spark, order, 9, 5, method="exact"))
        assert got == brute_histogram(brute_kmers(bases, 9), 5)


def test_splitting_reads_over_files_changes_nothing(spark, tmp_path):
    records = some_records(90)
    one = write(tmp_path / "all.fq", fastq(records))
    parts = [write(tmp_path / f"p{i}.fq", fastq(records[i::4])) for i in range(4)]
    whole = estimates(kmer_histogram_from_files(spark, one, 13, 5, r_exp=8))
    assert estimates(kmer_histogram_from_files(spark, parts, 13, 5, r_exp=8)) == whole


def test_file_column_names_the_input(spark, tmp_path):
    path = write(tmp_path / "a.fq", fastq(some_records(3)))
    fasta = write(tmp_path / "a.fa", ">x\nACGT\n")
    files = {r["file"] for r in read_sequences(spark, [path, fasta], 2).collect()}
    assert {f.rsplit("/", 1)[1] for f in files} == {"a.fq", "a.fa"}


def test_fastq_is_read_without_a_shuffle_once_it_fills_the_cores(spark, tmp_path, small_splits):
    path = write(tmp_path / "a.fq", fastq(some_records(300)))
    small_splits(2000)
    plan = canonical_kmers(read_sequences(spark, path, 9), 9)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1


def test_one_gzip_file_is_dealt_out(spark, tmp_path):
    (tmp_path / "a.fq.gz").write_bytes(gzip.compress(fastq(some_records(300)).encode()))
    plan = read_sequences(spark, str(tmp_path / "a.fq.gz"), 9)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plain_files_stay_in_their_splits_beside_gzip(spark, tmp_path, small_splits):
    reads = "".join(f"@r\n{'ACGT' * 20}\n+\n{'I' * 80}\n" for _ in range(400))
    (tmp_path / "a.fq").write_text(reads)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as out:
        out.write(reads)
    small_splits(2000)
    both = read_sequences(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq.gz")], 21)
    plan = executed(both)
    assert plan.count("FileScan") + plan.count("Scan text") >= 2 and plan.count("Exchange") == 1
    assert "Exchange" not in executed(read_sequences(spark, str(tmp_path / "a.fq"), 21))
    assert both.count() == 800


def test_plain_and_gzip_files_in_one_folder(spark, tmp_path):
    (tmp_path / "x.fq").mkdir()
    (tmp_path / "x.fq" / "part-1.txt").write_text("@r\nACGT\n+\nIIII\n")
    with gzip.open(tmp_path / "x.fq" / "part-2.txt.gz", "wt") as out:
        out.write("@r\nTTTT\n+\nIIII\n")
    found = read_sequences(spark, str(tmp_path / "x.fq"), 3)
    assert sorted(r["seq"] for r in found.collect()) == ["ACGT", "TTTT"]


@pytest.mark.parametrize("large", ["true", "false"])
def test_only_edges_of_fasta_splits_are_shuffled(spark, tmp_path, small_splits, large):
    rng = random.Random(4)
    seq = "".join(rng.choices("ACGT", k=9000))
    (tmp_path / "a.fa").write_text(">r\n" + "\n".join(seq[i : i + 60] for i in range(0, 9000, 60)) + "\n")
    small_splits(700)
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", large)
    try:
        found = read_sequences(spark, str(tmp_path / "a.fa"), 21)
        plan = executed(found)
        # Both parts of the union read the file; only the one with a window has an exchange.
        tiles, edges = plan.split("Window", 1)[0], plan.split("Window", 1)[1]
        assert plan.count("Exchange") == 1 and "Exchange" in edges and "Exchange" not in tiles
        assert canonical_kmers(found, 21).count() == 9000 - 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from merscope.plans.scratch import scratch_dir

    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    assert scratch_dir(Session(spark_master="local[4]")).startswith("/")
    assert scratch_dir(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y")).startswith("hdfs://x/y/")
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch_dir(Session(spark_master=master))


@pytest.mark.parametrize("name, source, rows", [("fasta_split_borders", "lineitem", 6000), ("stream_histogram", "events", 3000)])
def test_written_files_follow_the_partitions_of_the_table(spark, tmp_path, monkeypatch, name, source, rows):
    from merscope.plans import catalog

    table = spark.read.parquet(f"/root/testdata/sf0.001/{source}.parquet").limit(rows)
    table.repartition(6).write.parquet(str(tmp_path / "in" / f"{source}.parquet"))
    made, scratch = [], catalog.scratch_dir
    monkeypatch.setattr(catalog, "scratch_dir", lambda s: made.append(scratch(s)) or made[-1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 16)
    try:
        assert catalog.QUERIES[name](spark, str(tmp_path / "in")).count() > 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    written = [p for p in os.listdir(made[0].removeprefix("file:")) if p.startswith("part-")]
    assert len(written) > 4


@pytest.mark.parametrize("kind", ["fasta", "fastq"])
def test_many_small_splits_are_read_by_fewer_tasks(spark, tmp_path, small_splits, kind):
    rng = random.Random(8)
    seqs = ["".join(rng.choices("ACGTN", k=90)) for _ in range(400)]
    for name, some in (("a", seqs[:150]), ("b", seqs[150:])):
        form = ">r\n{0}\n" if kind == "fasta" else "@r\n{0}\n+\n{0}\n"
        (tmp_path / name).write_text("".join(form.format(s) for s in some))
    small_splits(50)
    found = read_sequences(spark, str(tmp_path), 11, kind)
    scans = 2 if kind == "fasta" else 1
    assert found.rdd.getNumPartitions() <= 256 * scans
    counts = canonical_kmers(found, 11).groupBy("kmer").count()
    got = {r["kmer"]: r["count"] for r in counts.select(decode_words(11).alias("kmer"), "count").collect()}
    assert got == dict(brute_kmers(seqs, 11))
