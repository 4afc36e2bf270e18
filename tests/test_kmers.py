import random
from collections import Counter

import pytest
from kmer_cases import brute_histogram, brute_kmers, estimates, frame, random_seqs, rc
from pyspark.sql import functions as F

from merscope import kmer_histogram
from merscope.functions.bases import decode_words
from merscope.operators.exact import abundance_histogram, distinct_kmers, kmer_counts
from merscope.operators.kmers import canonical_kmer_strings, canonical_kmers, counted_kmers
from merscope.operators.segments import segments, tile_sequences

RNG = random.Random(7)
READS = random_seqs(RNG, 60, 0, 220, "ACGT" * 8 + "acgtNn-@R") + ["", "N", "é" * 5 + "ACGTACGT" * 20]
WIDTHS = [1, 2, 4, 5, 21, 30, 31, 32, 33, 62, 63, 64, 65, 93, 94, 150]


def packed_counts(reads, k):
    rows = canonical_kmers(reads, k).select(decode_words(k).alias("kmer"))
    return {r["kmer"]: r["n"] for r in rows.groupBy("kmer").agg(F.count("*").alias("n")).collect()}


@pytest.mark.parametrize("k", WIDTHS)
def test_packed_kmers_against_brute_force(spark, k):
    assert packed_counts(frame(spark, READS), k) == brute_kmers(READS, k)


@pytest.mark.parametrize("k", [1, 2, 21, 31, 33, 64, 65, 150])
def test_string_kmers_against_brute_force(spark, k):
    rows = kmer_counts(canonical_kmer_strings(frame(spark, READS), k)).collect()
    assert {r["kmer"]: r["cnt"] for r in rows} == brute_kmers(READS, k)


def test_null_and_short_sequences_give_nothing(spark):
    reads = spark.createDataFrame([(None,), ("",), ("ACG",)], "seq string")
    assert canonical_kmers(reads, 4).count() == 0
    assert canonical_kmer_strings(reads, 4).count() == 0


def test_segments(spark):
    rows = segments(frame(spark, ["NNacgTNxGGé-T", "", "AC"]), 1).collect()
    assert Counter(r["segment"] for r in rows) == Counter(["ACGT", "GG", "T", "AC"])
    rows = segments(frame(spark, ["NNacgTNxGGé-T"]), 2).collect()
    assert Counter(r["segment"] for r in rows) == Counter(["ACGT", "GG"])


@pytest.mark.parametrize("k,tile", [(1, 10), (5, 10), (21, 8), (21, 64), (64, 100)])
def test_tiles_hold_each_window_once(spark, k, tile):
    seqs = random_seqs(RNG, 20, 0, 700, "ACGTN") + ["A" * (tile + k - 1), "C" * (tile + k), "é" * 200]
    tiles = tile_sequences(frame(spark, seqs), k, tile=tile).select(F.col("tile").cast("string").alias("seq"))
    rows = kmer_counts(canonical_kmer_strings(tiles, k)).collect()
    assert {r["kmer"]: r["cnt"] for r in rows} == brute_kmers(seqs, k)
    longest = tile_sequences(frame(spark, seqs), k, tile=tile).agg(F.max(F.length("tile"))).first()[0]
    assert longest <= max(tile, k) + k - 1


@pytest.mark.parametrize("k", [21, 33])
def test_one_long_sequence(spark, k):
    seq = "".join(RNG.choices("ACGT", k=300_000))
    assert packed_counts(frame(spark, [seq]), k) == brute_kmers([seq], k)


@pytest.mark.parametrize("k", [3, 21, 33])
def test_exact_histogram(spark, k):
    seqs = READS + READS[:20] + READS[:5]
    got = estimates(kmer_histogram(frame(spark, seqs), k, 8, method="exact"))
    assert got == brute_histogram(brute_kmers(seqs, k), 8)


def test_histogram_counts_every_occurrence(spark):
    kmers = canonical_kmers(frame(spark, READS), 5)
    total = kmers.count()
    rows = estimates(abundance_histogram(kmer_counts(kmers), 1000).orderBy("i"))
    assert sum(i * m for i, m in enumerate(rows)) == total
    assert distinct_kmers(kmers).first()["f0"] == rows[0] == sum(rows[1:])


def test_histogram_ignores_order_strand_and_partitioning(spark):
    want = estimates(kmer_histogram(frame(spark, READS), 9, 6, method="exact"))
    flipped = [rc(s.upper()) if set(s.upper()) <= set("ACGTN") else s for s in reversed(READS)]
    other = frame(spark, flipped).repartition(7)
    assert estimates(kmer_histogram(other, 9, 6, method="exact")) == want


def test_hot_kmer_is_combined_before_the_shuffle(spark):
    seqs = ["A" * 200] * 3000 + READS
    assert packed_counts(frame(spark, seqs), 21) == brute_kmers(READS, 21) + Counter({"A" * 21: 180 * 3000})


def test_empty_input_and_n_zero(spark):
    empty = frame(spark, READS).where("false")
    assert estimates(kmer_histogram(empty, 21, 3, method="exact")) == [0, 0, 0, 0]
    assert estimates(kmer_histogram(frame(spark, ["ACGTT"]), 5, 0, method="exact")) == [1]


@pytest.mark.parametrize("bad", [0, -1, 2.5, "x"])
def test_k_is_validated(spark, bad):
    with pytest.raises(ValueError):
        canonical_kmers(frame(spark, ["A"]), bad)


def test_method_and_n_are_validated(spark):
    reads = frame(spark, ["ACGT"])
    with pytest.raises(ValueError):
        kmer_histogram(reads, 3, 3, method="guess")
    with pytest.raises(ValueError):
        kmer_histogram(reads, 3, -1, method="exact")


@pytest.mark.parametrize("large", ["true", "false"])
def test_arrow_types_do_not_matter(spark, large):
    seqs = random_seqs(random.Random(8), 60, 1, 90)
    name = "spark.sql.execution.arrow.useLargeVarTypes"
    before = spark.conf.get(name)
    spark.conf.set(name, large)
    try:
        for k in (5, 33):
            assert canonical_kmers(frame(spark, seqs), k).count() == sum(brute_kmers(seqs, k).values())
    finally:
        spark.conf.set(name, before)


def test_other_arrow_types_are_refused():
    import pyarrow as pa

    from merscope.functions.arrow import text_and_offsets

    with pytest.raises(TypeError):
        text_and_offsets(pa.array([1, 2]))


@pytest.mark.parametrize("k", [1, 4, 11])
def test_short_kmers_are_counted_in_the_tasks(spark, k):
    seqs = random_seqs(random.Random(k), 300, 0, 400, "ACGTacgtN") + [None]
    counts = counted_kmers(frame(spark, seqs).repartition(3), k)
    assert "sum(cnt" in counts._jdf.queryExecution().executedPlan().toString()
    got = {r["kmer"]: r["cnt"] for r in counts.select(decode_words(k).alias("kmer"), "cnt").collect()}
    assert got == dict(brute_kmers([s for s in seqs if s], k))


def small_runs(monkeypatch, windows):
    """Workers are forked before: the function is made with the bound in its own globals."""
    from merscope.operators import kmers, packing

    def bounded(k):
        def count(batches):
            packing.RUN_WINDOWS = windows
            try:
                yield from packing.count_runs(k)(batches)
            finally:
                packing.RUN_WINDOWS = 1 << 19

        return count

    monkeypatch.setattr(kmers, "count_runs", bounded)


@pytest.mark.parametrize("k, windows", [(48, 1 << 19), (62, 100), (65, 1 << 19), (94, 7)])
def test_long_kmers_are_moved_in_runs_by_one_shuffle(spark, monkeypatch, k, windows):
    small_runs(monkeypatch, windows)
    rng = random.Random(k)
    genome = "".join(rng.choices("ACGT", k=3000))
    seqs = [genome[i : i + 150] for i in (rng.randrange(2850) for _ in range(200))]
    seqs += [rc(s) for s in seqs[:50]] + random_seqs(rng, 40, 0, 300, "ACGT" * 8 + "acgtN") + [None, "A" * 200, genome * 4]
    counts = counted_kmers(frame(spark, seqs).repartition(3), k)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(bin" in plan
    got = {r["kmer"]: r["cnt"] for r in counts.select(decode_words(k).alias("kmer"), "cnt").collect()}
    assert got == dict(brute_kmers([s for s in seqs if s], k))
