"""The sketch in blocks against the one in rows."""

import random

import numpy as np
import pytest
from kmer_cases import brute_histogram, brute_kmers, estimates, frame, random_seqs
from pyspark.sql import functions as F

from merscope import kmer_histogram
from merscope.functions import hash_arrays
from merscope.functions.hashing import multiply_parameters, xx_hash, xx_rehash
from merscope.operators import blocks, grouped
from merscope.operators.estimate import histogram_from_cells, histogram_from_levels
from merscope.operators.exact import kmer_counts
from merscope.operators.kmers import canonical_kmers
from merscope.operators.sketch import CELL_COLUMNS, MARK, SketchParams, full_levels, merge_cells
from merscope.plans.histogram import kmer_blocks, kmer_cells

RNG = random.Random(41)
GENOME = "".join(RNG.choices("ACGTN", weights=[20, 20, 20, 20, 1], k=9000))
READS = [GENOME[i : i + 90] for i in (RNG.randrange(len(GENOME) - 90) for _ in range(500))]


def cells(found):
    return sorted(tuple(r) for r in found.select(*CELL_COLUMNS).collect())


def histogram(found, params, n=5):
    return estimates(histogram_from_levels(blocks.block_level_histogram(found, params, n), params, n).orderBy("i"))


@pytest.mark.parametrize("family,k,seed", [("xxhash64", 15, 0), ("multiply", 31, 7), ("multiply", 33, 2), ("xxhash64", 70, 123456789)])
def test_blocks_hold_the_cells(spark, family, k, seed):
    params = SketchParams(r_exp=12, seed=seed, hash=family, copies=3)
    reads = frame(spark, READS)
    want = cells(kmer_cells(reads, k, params))
    assert cells(blocks.cells_of_blocks(kmer_blocks(reads, k, params), params)) == want
    assert cells(blocks.cells_of_blocks(kmer_blocks(reads, k, params, preaggregate=True), params)) == want


@pytest.mark.parametrize("params", [SketchParams(r_exp=16, u_exp=16), SketchParams(r_exp=3, u_exp=29, copies=1), SketchParams(r_exp=1, u_exp=1)])
def test_sizes_of_all_kinds(spark, params):
    reads = frame(spark, READS)
    want = estimates(histogram_from_cells(kmer_cells(reads, 15, params), params, 4).orderBy("i"))
    assert histogram(kmer_blocks(reads, 15, params), params, 4) == want


def rows(found):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in found.collect())


def test_order_partitions_and_early_sending_do_not_matter(spark, monkeypatch):
    params = SketchParams(r_exp=5, copies=3)
    want = rows(kmer_blocks(frame(spark, READS), 15, params))
    assert any(r[3] for r in want) and not all(r[3] for r in want)
    assert rows(kmer_blocks(frame(spark, READS[::-1]).repartition(9), 15, params)) == want
    monkeypatch.setattr(blocks, "MOST_BYTES", 5000)
    assert rows(kmer_blocks(frame(spark, READS).repartition(3), 15, params)) == want
    monkeypatch.setattr(blocks, "MOST_HITS", 100)
    monkeypatch.setattr(blocks, "PART_EXP", 3)
    small = kmer_blocks(frame(spark, READS), 15, params)
    assert histogram(small, params) == histogram(kmer_blocks(frame(spark, READS[::-1]), 15, params), params)


def test_marks_found_on_the_way_change_no_estimate(spark):
    seqs = random_seqs(random.Random(3), 1500, 100, 140)
    reads = frame(spark, seqs + seqs[:500])
    for r_exp in (6, 13):
        params = SketchParams(r_exp=r_exp, copies=3)
        in_rows = kmer_cells(reads, 21, params)
        found = kmer_blocks(reads, 21, params)
        full = blocks.full_pairs(found, params)
        assert full == sorted(full_levels(in_rows, params)) and bool(full) == (r_exp < 13)
        assert histogram(found, params) == estimates(histogram_from_cells(in_rows, params, 5).orderBy("i"))
        back = blocks.cells_of_blocks(found, params)
        assert sorted((r["copy"], r["level"]) for r in back.where(F.col("col") == MARK).collect()) == full
        assert estimates(histogram_from_cells(back, params, 5).orderBy("i")) == histogram(found, params)


def test_a_task_stops_looking_at_a_level_it_has_filled():
    """The mark goes out without cells, and what is full is sent as nothing else."""
    params = SketchParams(r_exp=6, copies=1)
    sketch = blocks.TaskSketch(params)
    rng = np.random.default_rng(1)
    for _ in range(20):
        sketch.add([rng.integers(0, 1 << 42, 1000)])
    assert (0, 0) in sketch.closed and (0, 0) not in sketch.levels
    sent = [row for batch in sketch.send() for row in batch.to_pylist()]
    full = [r for r in sent if r["full"]]
    assert {(r["copy"], r["level"]) for r in full} >= {(0, 0), (0, 1)} and all(r["cols"] == b"" for r in full)
    assert not [r for r in sent if (r["copy"], r["level"]) == (0, 0) and not r["full"]]
    sketch.add([rng.integers(0, 1 << 42, 1000)])
    assert all(r["level"] > 0 for batch in sketch.send() for r in batch.to_pylist())


def test_proven_levels_and_merges_with_rows(spark):
    large, small = frame(spark, READS * 3), frame(spark, READS[:7])
    params = SketchParams(r_exp=5, copies=3)
    plain = kmer_blocks(large, 15, params)
    proven = kmer_blocks(large, 15, params, prove_with=frame(spark, READS[:300]))
    assert histogram(plain, params) == histogram(proven, params)
    union = estimates(histogram_from_cells(kmer_cells(large.unionByName(small), 15, params), params, 5).orderBy("i"))
    merged = merge_cells(blocks.cells_of_blocks(proven, params), kmer_cells(small, 15, params))
    assert estimates(histogram_from_cells(merged, params, 5).orderBy("i")) == union
    both = blocks.merge_blocks(plain.unionByName(kmer_blocks(small, 15, params)), params)
    assert histogram(both, params) == union


def test_counts_beyond_16_and_32_bits(spark):
    hot = frame(spark, ["A" * 521] * 140)
    params = SketchParams(r_exp=13, copies=3)
    reads = frame(spark, READS).unionByName(hot)
    assert cells(blocks.cells_of_blocks(kmer_blocks(reads, 21, params), params)) == cells(kmer_cells(reads, 21, params))
    weighted = kmer_counts(canonical_kmers(hot, 21)).withColumn("cnt", F.lit(5_000_000_000).cast("bigint"))
    found = blocks.cells_of_blocks(blocks.merge_blocks(blocks.blocks_of_counts(weighted, 21, params), params), params)
    assert {r["cnt"] for r in found.collect()} == {5_000_000_000}


def test_one_row_a_block_is_shuffled(spark):
    """A task sends a block as one row, however many k-mers fell into it."""
    params = SketchParams(r_exp=12)
    sent = blocks.blocks_of_reads(frame(spark, READS).coalesce(1), 15, params)
    occupied = kmer_cells(frame(spark, READS), 15, params).select("copy", "level").distinct().count()
    assert sent.count() == occupied * blocks.parts(params)


def test_array_hashes_equal_the_column_functions(spark):
    numbers = [0, 1, 5, 2**40 + 3, 2**62 - 1]
    frame_ = spark.createDataFrame([(n,) for n in numbers], "kmer bigint")
    got = frame_.select(xx_hash(["kmer"], 3, 11).alias("h")).withColumn("u", xx_rehash(F.col("h"))).collect()
    h = hash_arrays.xx_hash([np.array(numbers)], 3, 11)
    assert [r["h"] for r in got] == h.tolist()
    assert [r["u"] for r in got] == hash_arrays.xx_rehash(h, 3, 11).tolist()


def test_multiplication_in_limbs(spark):
    """No limb overflows under ANSI arithmetic, at the ends of the range either."""
    from merscope.functions.hashing import multiply_rehash

    spark.conf.set("spark.sql.ansi.enabled", "true")
    rng = random.Random(2)
    values = [0, 1, 2**63 - 1, 2**32 - 1, 2**32, *(rng.randrange(2**63) for _ in range(40))]
    frame_ = spark.createDataFrame([(v,) for v in values], "h bigint")
    for factor, summand in [(2**64 - 1, 2**64 - 1), (1, 0), multiply_parameters(0, 0), multiply_parameters(6, -3)]:
        halves = [tuple(F.lit(x).cast("bigint") for x in (n >> 32, n & (2**32 - 1))) for n in (factor, summand)]
        got = [r[0] for r in frame_.select(multiply_rehash(F.col("h"), *halves)).collect()]
        assert got == [(v * factor + summand) % 2**64 >> 32 for v in values]


def test_md5_has_no_blocks(spark):
    with pytest.raises(ValueError, match="blocks need"):
        kmer_blocks(frame(spark, ["ACGT"]), 3, SketchParams(hash="md5"))


def test_groups(spark):
    """Each group's histogram is that of its reads alone; coarser ones merge; HLL agrees."""
    named = [("a", s) for s in READS[:200]] + [("b", s) for s in READS[200:230]] + [(None, s) for s in READS[230:260]] + [("short", "ACG")]
    reads = spark.createDataFrame(named, "name string, seq string")
    params = SketchParams(r_exp=12, copies=3)
    found = grouped.grouped_blocks(reads, F.col("name"), 15, params)
    got = {}
    for r in grouped.grouped_histogram(found, params, 3).collect():
        got.setdefault(r["grp"], {})[r["i"]] = r["est"]
    assert set(got) == {"a", "b", None}
    for name in got:
        alone = frame(spark, [s for g, s in named if g == name])
        assert [got[name][i] for i in range(4)] == estimates(kmer_histogram(alone, 15, 3, r_exp=12, copies=3))
    top = grouped.grouped_histogram(grouped.rolled_up(found, F.coalesce("grp", F.lit("b")), params), params, 3)
    assert {(r["grp"], r["i"]): r["est"] for r in top.collect()}["b", 0] == estimates(
        kmer_histogram(frame(spark, [s for g, s in named if g != "a"]), 15, 3, r_exp=12, copies=3)
    )[0]
    kmers = canonical_kmers(frame(spark, READS[:200]), 15)
    hll = kmers.agg(F.hll_sketch_estimate(F.hll_sketch_agg("kmer", 14))).first()[0]
    truth = brute_histogram(brute_kmers(READS[:200], 15), 0)[0]
    assert abs(hll - truth) < 0.05 * truth and abs(got["a"][0] - truth) < 0.1 * truth


def test_many_groups_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(grouped, "MOST_GROUPS", 2)
    reads = spark.createDataFrame([(str(i % 23), s) for i, s in enumerate(READS[:100])], "name string, seq string")
    params = SketchParams(r_exp=8, copies=1)
    got = grouped.grouped_histogram(grouped.grouped_blocks(reads, F.col("name"), 15, params), params, 2)
    want = {str(g): estimates(kmer_histogram(frame(spark, READS[:100][g::23]), 15, 2, r_exp=8, copies=1)) for g in (0, 22)}
    found = {(r["grp"], r["i"]): r["est"] for r in got.collect()}
    assert all([found[g, i] for i in range(3)] == w for g, w in want.items())


def test_sql_functions(spark):
    from merscope.functions.sql import register_sql

    register_sql(spark)
    seqs = READS[:40] + [None, "", "ACG", "acgtNACGTT"]
    frame(spark, seqs).createOrReplaceTempView("reads_of_test")
    for k in (3, 40):
        got = spark.sql(f"SELECT kmer, count(*) AS n FROM reads_of_test, LATERAL kmers(seq, {k}) GROUP BY kmer")
        assert {r["kmer"]: r["n"] for r in got.collect()} == dict(brute_kmers([s for s in seqs if s], k))
    row = spark.sql("SELECT reverse_complement('AACGT') AS a, canonical('TTT') AS b, normalised('acgtn') AS c").first()
    assert tuple(row) == ("ACGTT", "AAA", "ACGTn")
    with pytest.raises(Exception, match="positive integer"):
        spark.sql("SELECT * FROM kmers('ACGT', 0)").collect()


def test_sql_kmers_stay_in_their_task_without_python(spark):
    from merscope.functions.sql import register_sql

    register_sql(spark)
    frame(spark, [*READS[:40], "ACGT" * 20_000, "é" * 40 + "acgtt"]).createOrReplaceTempView("reads_of_test")
    found = spark.sql("SELECT kmer FROM reads_of_test, LATERAL kmers(seq, 5)")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "UDTF", "Join", "Exchange"))
    want = brute_kmers([*READS[:40], "ACGT" * 20_000, "ACGTT"], 5)
    assert {r["kmer"]: r["count"] for r in found.groupBy("kmer").count().collect()} == dict(want)
    with pytest.raises(Exception, match="positive integer"):
        spark.sql("SELECT kmer FROM reads_of_test, LATERAL kmers(seq, CAST(NULL AS INT))").collect()


def test_a_task_sends_each_cell_of_the_production_size_once():
    """Levels that are neither sparse nor full fit in, so nothing is sent twice; hits take few bytes."""
    params = SketchParams()
    sketch, rng = blocks.TaskSketch(params), np.random.default_rng(3)
    for _ in range(16):
        sketch.add([rng.integers(0, 1 << 42, 1 << 17)])
        assert not sketch.should_send()
    rows = [row for row in sketch.rows() if not row[3]]
    cells = sum(len(row[4]) // 2 for row in rows)
    assert sum(map(len, (x for row in rows for x in row[4:]))) < 7.1 * cells
    assert sum(int(blocks.cells_of_row(*row[4:], params.u_exp).cnt.sum()) for row in rows) == 16 * (1 << 17) * params.copies


def test_hits_of_all_widths_come_back():
    for most in (1, 255, 256, 65536, 1 << 32, 1 << 40):
        cnt = np.array([1, most])
        cells = blocks.Cells(np.array([3, 9]), np.array([1, 2], np.uint32), np.array([1, 5], np.uint32), cnt)
        row = blocks.block_row(0, 0, 0, cells, 1 << 14, 13)
        assert blocks.cells_of_row(*row[4:], 13).cnt.tolist() == cnt.tolist()
