import re
import random

import pytest
from kmer_cases import SF, brute_histogram, brute_kmers, frame, random_seqs

from merscope.cli import main
from merscope.plans.histogram import kmer_histogram
from merscope.plans.telemetry import RunCounts
from merscope.plans.report import parameter_line, report_rows, report_text


@pytest.fixture
def reads(tmp_path):
    seqs = random_seqs(random.Random(2), 80, 30, 60)
    seqs += seqs[:20]
    path = tmp_path / "reads.fq"
    path.write_text("".join(f"@r\n{s}\n+\n{'I' * len(s)}\n" for s in seqs))
    return str(path), seqs


def test_no_arguments_prints_usage(capsys):
    assert main([]) == 0
    assert "Usage" in capsys.readouterr().out


def test_report_file(spark, tmp_path, reads, capsys):
    path, seqs = reads
    out = tmp_path / "out.txt"
    out.write_text("old content that is longer than the report" * 100)
    assert main(["-k", "15", "-f", "4", "-o", str(out), "-i", path, "--method", "exact"]) == 0
    f = brute_histogram(brute_kmers(seqs, 15), 4)
    assert out.read_text().splitlines() == [
        f"#Parms :  k = 15; nfreq = 4; infile(s) = {path}, ; outfile = {out}; copies = 7",
        f"#F0 = {f[0]}",
        "f\tk=15",
        *[f"f{i}\t{f[i]}" for i in range(1, 5)],
    ]
    printed = capsys.readouterr().out
    assert "finished after" in printed and str(out) in printed
    assert f"read: {len(seqs)} sequences, {sum(map(len, seqs))} bases, 0 other symbols" in printed


@pytest.mark.parametrize("method", ["exact", "sketch"])
def test_a_run_counts_what_it_reads(spark, method):
    counts = RunCounts()
    kmer_histogram(frame(spark, ["ACGTNNac", "", None, "T-GA"]), 3, 2, method=method, r_exp=8, counts=counts).collect()
    assert counts.get() == {"sequences": 3, "symbols": 12, "bases": 9}


def test_sketch_is_the_default_and_repeats(spark, tmp_path, reads):
    path, seqs = reads
    texts = []
    for name in ("a", "b"):
        out = tmp_path / name
        assert main(["-o", str(out), "-i", path, path, "--seed", "4"]) == 0
        texts.append(out.read_text().splitlines()[1:])
    assert texts[0] == texts[1] and len(texts[0]) == 10
    f0 = int(texts[0][0].split("= ")[1])
    truth = len(brute_kmers(seqs, 21))
    assert abs(f0 - truth) < 0.1 * truth


def test_unknown_arguments_are_ignored_with_a_note(spark, tmp_path, reads, capsys):
    out = tmp_path / "o"
    assert main(["-x", "-o", str(out), "-i", reads[0], "--method", "exact"]) == 0
    assert "ignored: -x" in capsys.readouterr().err


@pytest.mark.parametrize(
    "argv", [["-k", "5"], ["-k", "0", "-i", "a.fq"], ["-i", "a.txt"], ["-f", "-1", "-i", "a.fq"], ["-i", "none.fq"]]
)
def test_bad_arguments(spark, tmp_path, argv):
    assert main([*argv, "-o", str(tmp_path / "o")]) == 1
    assert not (tmp_path / "o").exists()


@pytest.mark.parametrize("argv", [["-k"], ["-k", "x"], ["-i"]])
def test_missing_values(argv):
    with pytest.raises(SystemExit):
        main(argv)


def test_report_rows_match_the_file(spark):
    histogram = kmer_histogram(frame(spark, ["ACGTACGTTT", "GGG"]), 3, 3, method="exact")
    lines = [r["line"] for r in report_rows(histogram, 3).orderBy("line_no").collect()]
    rows = [(r["i"], r["est"]) for r in histogram.collect()]
    text = report_text(rows, 3, parameter_line(3, 3, ["a.fa"], "o", 7))
    assert text.splitlines()[1:] == lines


def test_entry_point(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert [r["i"] for r in rows] == list(range(9)) and rows[0]["est"] > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    missing = set(entry.queries()) - set(entry.oracle_sql())
    # Training data queries that SQL cannot express have brute-force tests.
    assert not {name for name in missing if not re.match(r"op\d+_|pipeline$", name)}


def test_production_sketch_follows_the_exact_counts(spark):
    """The one query without SQL: compare with the exact histogram."""
    from merscope.plans.catalog import QUERIES

    exact = [r["est"] for r in QUERIES["kmer_histogram_exact"](spark, SF).collect()]
    sketch = [r["est"] for r in QUERIES["kmer_histogram_sketch_xx"](spark, SF).collect()]
    assert len(exact) == len(sketch)
    for want, got in zip(exact, sketch):
        assert abs(want - got) <= 0.1 * want + 30
