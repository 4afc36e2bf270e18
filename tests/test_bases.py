import random

import numpy as np
import pytest
from kmer_cases import frame, rc
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from merscope.functions import bases
from merscope.functions.hashing import level_of
from merscope.operators.packing import base_codes, canonical_words, packed_windows


def pack(text):
    value = 0
    for base in text:
        value = value * 4 + "ACGT".index(base)
    return value


def test_string_functions(spark):
    seqs = ["A", "ACGT", "TTTT", "GATTACA", "C" * 31, "T" * 31]
    rows = frame(spark, seqs).select(
        "seq",
        bases.reverse_complement(F.col("seq")).alias("rc"),
        bases.canonical(F.col("seq")).alias("canonical"),
        bases.encode_2bit(F.col("seq")).alias("code"),
    )
    for r in rows.collect():
        assert r["rc"] == rc(r["seq"])
        assert r["canonical"] == min(r["seq"], rc(r["seq"]))
        assert r["code"] == pack(r["seq"])


def test_normalise_folds_only_bases(spark):
    text = "acgtnACGTNẗı-"
    assert frame(spark, [text]).select(bases.normalise(F.col("seq"))).first()[0] == "ACGTnACGTNẗı-"


def test_symbol_class_counts(spark):
    text = "AaCgTtNn\r\n+@>x é"
    counts = bases.symbol_class_counts(F.col("seq"))
    row = frame(spark, [text, "", None]).agg(*[c.alias(s) for s, c in counts.items()]).first()
    expected = dict(A=2, C=1, G=1, T=2, N=2, CR=1, NL=1, PLUS=1, AT=1, GT=1, OTHER=4)
    assert row.asDict() == expected


@pytest.mark.parametrize("k", [1, 2, 3, 30, 31, 32, 33, 62, 63, 64, 65, 100])
def test_words_cover_a_kmer(k):
    spans = bases.word_spans(k)
    assert spans[0][0] == 0 and spans[-1][1] == k
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert len(bases.word_names(k)) == len(spans)


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=90), st.integers(1, 31))
def test_packed_windows(text, n):
    codes = base_codes()[np.frombuffer(text.encode(), np.uint8)]
    fwd, rev = packed_windows(codes, {n})[n]
    want = [text[i : i + n] for i in range(len(text) - n + 1)]
    assert fwd.tolist() == [pack(w) for w in want]
    assert rev.tolist() == [pack(rc(w)) for w in want]


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=140), st.integers(1, 130))
def test_canonical_words(text, k):
    if k > len(text):
        return
    codes = base_codes()[np.frombuffer(text.encode(), np.uint8)]
    words = canonical_words(codes, k)
    for i in range(len(text) - k + 1):
        kmer = min(text[i : i + k], rc(text[i : i + k]))
        assert [int(w[i]) for w in words] == [pack(kmer[a:b]) for a, b in bases.word_spans(k)]


def test_decode_words(spark):
    rng = random.Random(1)
    for k in (1, 31, 32, 65):
        kmer = "".join(rng.choices("ACGT", k=k))
        row = {n: pack(kmer[a:b]) for n, (a, b) in zip(bases.word_names(k), bases.word_spans(k))}
        schema = ", ".join(f"{n} bigint" for n in row)
        assert spark.createDataFrame([tuple(row.values())], schema).select(bases.decode_words(k)).first()[0] == kmer


def test_level_is_the_trailing_zero_count(spark):
    values = [0, 1, 2, 3, 4, 8, 96, 1 << 62, (1 << 63) - 1]
    frame_ = spark.createDataFrame([(v,) for v in values], "h bigint")
    got = [r[0] for r in frame_.select(level_of(F.col("h"))).collect()]
    assert got == [63, 0, 1, 0, 2, 3, 5, 62, 0]
