"""Column functions over bases and k-mer strings.

Every function takes and returns Columns built from Spark built-ins, so they
stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet in code order (A=0, C=1, G=2, T=3), the complement
# of each base, and the symbol classes the file formats give a meaning to.
BASES = "ACGT"
COMPLEMENTS = "TGCA"
CODES = "0123"
SYMBOL_CLASSES = {
    "A": "Aa",
    "C": "Cc",
    "G": "Gg",
    "T": "Tt",
    "N": "Nn",
    "CR": "\r",
    "NL": "\n",
    "PLUS": "+",
    "AT": "@",
    "GT": ">",
}

NON_BASES = "[^ACGT]+"

# Bases that fit one signed 64-bit word with the sign bit left clear, so that
# comparing words as signed longs orders them like the base strings.
BASES_PER_WORD = 31


def normalise(seq: Column) -> Column:
    """Fold lower-case bases; every other character stays as it is.

    ``upper`` would be wrong here: Unicode upper-casing can turn a foreign
    letter into an ASCII base.
    """
    return F.translate(seq, BASES.lower(), BASES)


def complement(seq: Column) -> Column:
    return F.translate(seq, BASES, COMPLEMENTS)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def encode_2bit(kmer: Column) -> Column:
    """Pack a string of at most 31 bases into a BIGINT, first base highest."""
    return F.conv(F.translate(kmer, BASES, CODES), 4, 10).cast("bigint")


def decode_2bit(word: Column, length: int) -> Column:
    """Inverse of :func:`encode_2bit` for a string of ``length`` bases."""
    digits = F.lpad(F.conv(word.cast("string"), 10, 4), length, CODES[0])
    return F.translate(digits, CODES, BASES)


def word_spans(k: int) -> list[tuple[int, int]]:
    """Base ranges ``[start, stop)`` of a k-mer held by each packed word."""
    return [(a, min(a + BASES_PER_WORD, k)) for a in range(0, k, BASES_PER_WORD)]


def word_names(k: int) -> list[str]:
    """Column names of a packed k-mer: ``kmer``, or ``kmer_0, kmer_1, ...``."""
    spans = word_spans(k)
    return ["kmer"] if len(spans) == 1 else [f"kmer_{i}" for i in range(len(spans))]


def decode_words(k: int) -> Column:
    """The base string of a packed k-mer row."""
    parts = [
        decode_2bit(F.col(name), stop - start)
        for name, (start, stop) in zip(word_names(k), word_spans(k))
    ]
    return F.concat(*parts)


def symbol_class_counts(text: Column) -> dict[str, Column]:
    """Sum aggregates counting the bytes of each symbol class in ``text``."""
    total = F.octet_length(text)
    counts = {
        name: F.length(text) - F.length(F.translate(text, chars, ""))
        for name, chars in SYMBOL_CLASSES.items()
    }
    known = sum(counts.values(), F.lit(0))
    counts["OTHER"] = total - known
    return {
        name: F.coalesce(F.sum(c.cast("bigint")), F.lit(0).cast("bigint"))
        for name, c in counts.items()
    }
