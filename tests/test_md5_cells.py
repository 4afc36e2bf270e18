"""Cells by the md5 hash, hashed in the tasks."""

import hashlib
import random

import numpy as np
import pytest
from kmer_cases import frame, random_seqs

from merscope.functions.hash_arrays import md5_hash
from merscope.operators.kmers import canonical_kmer_strings
from merscope.operators.sketch import CELL_COLUMNS, SketchParams, sketch_cells
from merscope.plans.histogram import kmer_cells


@pytest.mark.parametrize("k", [1, 21, 52, 53, 54, 61, 62, 130])
def test_array_md5(k):
    rng = random.Random(k)
    seqs = random_seqs(rng, 40, k, k)
    h, u = md5_hash(np.array([list(s.encode()) for s in seqs], np.uint8), 3, 0)
    for seq, own_h, own_u in zip(seqs, h.tolist(), u.tolist()):
        digest = hashlib.md5(f"3:{seq}".encode()).hexdigest()
        assert (own_h, own_u) == (int(digest[:15], 16), int(digest[16:24], 16))


def rows(cells):
    return sorted(tuple(r) for r in cells.select(*CELL_COLUMNS).collect())


@pytest.mark.parametrize("k, seed, r_exp", [(13, 0, 5), (33, 4, 9)])
def test_cells_by_occurrence_are_hashed_in_the_tasks(spark, k, seed, r_exp):
    rng = random.Random(k)
    some = random_seqs(rng, 60, 0, 200, "ACGT" * 8 + "acgtN")
    reads = frame(spark, [*some, *some, "A" * 300, None, ""]).repartition(3)
    params = SketchParams(r_exp=r_exp, seed=seed, hash="md5")
    found = kmer_cells(reads, k, params)
    assert "md5(" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == rows(sketch_cells(canonical_kmer_strings(reads, k), params))


def test_no_reads_no_cells(spark):
    assert rows(kmer_cells(frame(spark, ["", None]), 21, SketchParams(r_exp=6, hash="md5"))) == []
