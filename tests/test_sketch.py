import random

import pytest
from pyspark.errors import AnalysisException
from kmer_cases import brute_histogram, brute_kmers, estimates, frame, random_seqs
from pyspark.sql import functions as F

from merscope import kmer_histogram
from merscope.operators.estimate import best_levels, cell_value, fj_estimate, histogram_from_cells, level_histogram
from merscope.operators.kmers import canonical_kmer_strings, canonical_kmers
from merscope.operators.sketch import (
    CELL_COLUMNS,
    CELL_SCHEMA,
    MARK,
    SketchParams,
    full_levels,
    load_sketch,
    merge_cells,
    save_sketch,
    sketch_cells,
)
from merscope.plans.histogram import kmer_cells

RNG = random.Random(11)
GENOME = "".join(RNG.choices("ACGT", k=12_000))
READS = [GENOME[i : i + 90] for i in (RNG.randrange(len(GENOME) - 90) for _ in range(800))]
SMALL = SketchParams(r_exp=8)


def rows(cells):
    return sorted(tuple(r) for r in cells.select(*CELL_COLUMNS).collect())


@pytest.mark.parametrize("params", [SMALL, SketchParams(r_exp=8, hash="md5"), SketchParams(r_exp=8, copies=3, seed=5)])
def test_merge_equals_sketch_of_union(spark, params):
    whole = kmer_cells(frame(spark, READS), 15, params)
    parts = [kmer_cells(frame(spark, READS[i::3]), 15, params) for i in range(3)]
    assert rows(merge_cells(*parts)) == rows(whole)
    assert rows(merge_cells(whole)) == rows(whole)


def test_order_and_partitioning_do_not_matter(spark):
    a = kmer_cells(frame(spark, READS), 15, SMALL)
    b = kmer_cells(frame(spark, READS[::-1]).repartition(9), 15, SMALL)
    assert rows(a) == rows(b)


def test_preaggregation_changes_nothing(spark):
    reads = frame(spark, READS)
    plain = kmer_cells(reads, 33, SMALL)
    assert rows(kmer_cells(reads, 33, SMALL, preaggregate=True)) == rows(plain)


def test_cells_are_within_their_ranges(spark):
    params = SketchParams(r_exp=6, u_exp=9, copies=5)
    for r in kmer_cells(frame(spark, READS), 15, params).collect():
        assert 0 <= r["copy"] < 5 and 0 <= r["level"] <= 63
        assert 0 <= r["col"] < 64 and 0 <= r["pos_min"] <= r["pos_max"] < 512


def test_seeds_differ_and_repeat(spark):
    reads = frame(spark, READS)
    one = rows(kmer_cells(reads, 15, SketchParams(r_exp=8, seed=1)))
    assert one == rows(kmer_cells(reads, 15, SketchParams(r_exp=8, seed=1)))
    assert one != rows(kmer_cells(reads, 15, SketchParams(r_exp=8, seed=2)))


def test_cell_value_rules(spark):
    cells = spark.createDataFrame(
        [(0, 0, 0, 5, 5, 65534), (0, 0, 1, 5, 5, 65535), (0, 0, 2, 5, 6, 2), (0, 0, 3, 9, 9, 1)], CELL_SCHEMA
    )
    got = {r["col"]: r["v"] for r in cells.select("col", cell_value().alias("v")).collect()}
    assert got == {0: 65534, 1: None, 2: None, 3: 1}


def test_level_histogram_counts_empty_invalid_and_large(spark):
    params = SketchParams(r_exp=4)
    cells = spark.createDataFrame(
        [(0, 0, 0, 5, 5, 1), (0, 0, 1, 5, 5, 9), (0, 0, 2, 5, 6, 2), (0, 0, 3, 9, 9, 1), (2, 4, 3, 9, 9, 2)], CELL_SCHEMA
    )
    got = {(r["copy"], r["level"], r["v"]): r["t"] for r in level_histogram(cells, params, 3).collect()}
    assert got == {(0, 0, 0): 12, (0, 0, 1): 2, (2, 4, 0): 15, (2, 4, 2): 1}


def test_best_level_ties_and_unusable_levels(spark):
    params = SketchParams(r_exp=4)
    hist = spark.createDataFrame(
        [
            (0, 0, 0, 0), (0, 1, 0, 6), (0, 2, 0, 10), (0, 3, 0, 16),
            (0, 1, 1, 3), (0, 2, 1, 3), (0, 3, 1, 2),
            (1, 0, 0, 0), (1, 5, 0, 16),
        ],
        "copy int, level int, v bigint, t bigint",
    )
    got = {(r["copy"], r["v"]): (r["level"], r["t"]) for r in best_levels(hist, params).collect()}
    assert got == {(0, 0): (1, 6), (0, 1): (1, 3)}


@pytest.mark.parametrize("n", [0, 1, 5])
@pytest.mark.parametrize("hash", ["xxhash64", "md5"])
def test_empty_input_gives_zero_rows(spark, n, hash):
    empty = frame(spark, READS).where("false")
    assert estimates(kmer_histogram(empty, 21, n, r_exp=8, hash=hash)) == [0] * (n + 1)


def test_a_minority_of_copies_gives_zero(spark):
    params = SketchParams(r_exp=4, copies=3)
    cells = spark.createDataFrame([(0, 0, 0, 5, 5, 1)], CELL_SCHEMA)
    assert estimates(histogram_from_cells(cells, params, 1).orderBy("i")) == [0, 0]


@pytest.mark.parametrize("k", [15, 21, 33])
def test_large_sketch_is_close_to_the_truth(spark, k):
    truth = brute_histogram(brute_kmers(READS, k), 6)
    got = estimates(kmer_histogram(frame(spark, READS), k, 6, r_exp=16))
    for want, est in zip(truth, got):
        assert abs(est - want) <= 0.1 * want + 30


def test_levels_proven_full_do_not_change_the_estimates(spark):
    seqs = random_seqs(random.Random(3), 2000, 100, 140)
    reads = frame(spark, seqs + seqs[:900] + seqs[:300])
    part = frame(spark, seqs[:700])
    for r_exp in (5, 9, 14):
        params = SketchParams(r_exp=r_exp)
        cells = kmer_cells(reads, 21, params)
        proven = full_levels(kmer_cells(part, 21, params), params)
        assert bool(proven) == (r_exp < 14)
        assert set(proven) <= set(full_levels(cells, params))
        marked = kmer_cells(reads, 21, params, prove_with=part)
        assert sorted((r["copy"], r["level"]) for r in marked.where(F.col("col") == MARK).collect()) == sorted(proven)
        assert marked.where(F.col("col") != MARK).count() == cells.count() - len(proven) * params.columns
        want = estimates(histogram_from_cells(cells, params, 5).orderBy("i"))
        assert estimates(histogram_from_cells(marked, params, 5).orderBy("i")) == want
        assert full_levels(marked, params) and sorted(full_levels(marked, params)) == sorted(full_levels(cells, params)) if proven else True


@pytest.mark.parametrize("sizes", [(2000, 4), (8000, 4), (300, 300)])
def test_sketches_of_unequal_inputs_merge(spark, sizes):
    """However levels were left out, the merged sketch is that of the union."""
    rng = random.Random(sum(sizes))
    large, small = (frame(spark, random_seqs(rng, n, length, length)) for n, length in zip(sizes, (300, 120)))
    params = SketchParams(r_exp=8)
    union = histogram_from_cells(kmer_cells(large.unionByName(small), 21, params), params, 3)
    want = estimates(union.orderBy("i"))
    truth = sizes[0] * 280 + sizes[1] * 100
    assert abs(want[0] - truth) < 0.3 * truth
    whole, proven = (kmer_cells(large, 21, params, prove_with=p) for p in (None, large))
    for one in (whole, proven):
        for other in (kmer_cells(small, 21, params), kmer_cells(small, 21, params, prove_with=small)):
            for merged in (merge_cells(one, other), merge_cells(other, one)):
                assert estimates(histogram_from_cells(merged, params, 3).orderBy("i")) == want


def test_no_estimate_from_a_level_without_room(spark):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    params = SketchParams(r_exp=8)
    rows_ = spark.createDataFrame([(1, 0, 10**9), (1, 0, 10**5), (3, 9, 1000)], "t bigint, level int, f0 bigint")
    got = [r[0] for r in rows_.select(fj_estimate(F.col("t"), F.col("level"), F.col("f0"), params)).collect()]
    assert got[:2] == [None, None] and got[2] > 0


def test_save_and_load(spark, tmp_path):
    params = SketchParams(r_exp=8, seed=3)
    cells = kmer_cells(frame(spark, READS), 15, params)
    save_sketch(cells, str(tmp_path / "s"), 15, params)
    back, k, found = load_sketch(spark, str(tmp_path / "s"))
    assert (k, found) == (15, params) and rows(back) == rows(cells)


def test_the_newest_finished_sketch_counts(spark, tmp_path):
    path, params = str(tmp_path / "s"), SketchParams(r_exp=8)
    with pytest.raises(AnalysisException):
        load_sketch(spark, path)
    for k in (15, 17):
        save_sketch(kmer_cells(frame(spark, READS[:40]), k, params), path, k, params)
    cells, k, _ = load_sketch(spark, path)
    assert k == 17 and rows(cells) == rows(kmer_cells(frame(spark, READS[:40]), 17, params))
    # Cells of a save that never came to its last step are not looked at.
    kmer_cells(frame(spark, READS[:5]), 19, params).write.parquet(f"{path}/cells/unfinished")
    assert load_sketch(spark, path)[1] == 17


@pytest.mark.parametrize("bad", [dict(copies=4), dict(copies=0), dict(r_exp=25), dict(r_exp=0), dict(hash="crc")])
def test_parameters_are_validated(bad):
    with pytest.raises(ValueError):
        SketchParams(**bad)


def test_too_many_frequencies_are_refused(spark):
    with pytest.raises(ValueError):
        kmer_histogram(frame(spark, ["ACGT"]), 3, 65535)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_input_is_read_once_per_pass(spark, tmp_path):
    frame(spark, READS).write.parquet(str(tmp_path / "r"))
    reads = spark.read.parquet(str(tmp_path / "r"))
    assert plan_of(kmer_histogram(reads, 21, 8, method="exact")).count("FileScan") == 1
    sketch = plan_of(kmer_histogram(reads, 21, 8))
    assert sketch.count("FileScan") == 1
    assert "Join" not in sketch and "CartesianProduct" not in sketch
    weighted = sketch_cells(canonical_kmers(reads, 21), SMALL)
    assert plan_of(weighted).count("Exchange") == 1


def test_one_kmer_holding_most_rows(spark):
    """A hot k-mer saturates its cells; everything else is counted as before."""
    hot = frame(spark, ["A" * 521] * 140)  # 70,000 + occurrences of one 21-mer
    cells = kmer_cells(frame(spark, READS).unionByName(hot), 21, SMALL)
    assert cells.agg(F.max("cnt")).first()[0] >= 140 * 501
    assert cells.where(cell_value().isNull() & (F.col("cnt") >= 65535)).groupBy("copy").count().count() == 7
    top = estimates(kmer_histogram(frame(spark, READS).unionByName(hot), 21, 3, r_exp=16))
    truth = brute_histogram(brute_kmers(READS, 21), 3)
    for want, est in zip(truth, top):
        assert abs(est - want) <= 0.1 * want + 30


@pytest.mark.parametrize("prove", [False, True])
def test_few_kmers_are_counted_packed_before_they_are_spelled_and_hashed(spark, prove):
    params = SketchParams(r_exp=6, hash="md5")
    reads = frame(spark, READS)
    cells = kmer_cells(reads, 11, params, prove_with=reads if prove else None)
    plan = plan_of(cells)
    assert plan.count("Exchange") >= 2 and "MapInArrow" in plan and plan.count("Generate") <= 2
    plain = sketch_cells(canonical_kmer_strings(reads, 11), params)
    if prove:
        assert estimates(histogram_from_cells(cells, params, 8)) == estimates(histogram_from_cells(plain, params, 8))
    else:
        assert rows(cells) == rows(plain)
