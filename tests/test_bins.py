"""K-mers counted in the tasks and moved as packed arrays by bins."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from merscope.operators import packing
from merscope.operators.kmers import counted_kmers


def in_order_of_bins(sent):
    table = pa.Table.from_batches(sent)
    return table.sort_by("bin").to_batches(max_chunksize=7)


@pytest.mark.parametrize("k", [12, 21, 31, 33, 47])
@pytest.mark.parametrize("held", [64, 1 << 22])
def test_kmers_are_counted_in_packed_bins(monkeypatch, k, held):
    monkeypatch.setattr(packing, "HELD", held)
    monkeypatch.setattr(packing, "ROWS", 50)
    monkeypatch.setattr(packing, "MERGED", 8)
    rng = random.Random(k)
    some = ["".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=rng.randint(0, 200))) for _ in range(30)]
    reads = [*some, *some, "A" * 300, ""]
    batches = [pa.record_batch([pa.array([(r + "\n").encode() for r in part], pa.binary())], ["tile"]) for part in (reads[:20], [], reads[20:])]
    sent = [b for task in (batches[:2], batches[2:]) for b in packing.bin_batches(k)(iter(task))]
    found = Counter()
    for batch in packing.merge_bins(k)(iter(in_order_of_bins(sent))):
        for *words, cnt in zip(*(c.to_pylist() for c in batch.columns)):
            assert tuple(words) not in found
            found[tuple(words)] = cnt
    expected = Counter()
    for batch in packing.kmer_batches(k)(iter(batches)):
        expected.update(zip(*(c.to_pylist() for c in batch.columns)))
    assert found == expected


def test_different_kmers_of_one_mixed_number_stay_apart():
    one, other = 0x9E3779B97F4A7C15, 0x9E3779B97F4A7C17
    words = [np.array([other, 0, other, 0], np.uint64).view(np.int64), np.array([0, one, 0, one], np.uint64).view(np.int64)]
    assert len(set(packing.mixed(words).tolist())) == 1
    _, rows, counts = packing.counted_rows(words, np.array([1, 10, 100, 1000]))
    assert dict(zip(zip(*(r.tolist() for r in rows)), counts.tolist())) == {
        (words[0][0].item(), 0): 101,
        (0, words[1][1].item()): 1010,
    }


def test_a_row_is_shuffled_for_a_bin_and_not_for_a_kmer(spark):
    reads = spark.createDataFrame([("ACGT" * 5000,)] * 8, "seq string").repartition(2)
    plan = counted_kmers(reads, 21)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan
    assert sorted(r["cnt"] for r in counted_kmers(reads, 21).collect()) == sorted(Counter(
        min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))) for i in range(20000 - 20) for w in [("ACGT" * 5000)[i : i + 21]] * 8).values())
