"""Seeded k-mer hashes and the sketch coordinates taken from them.

A hash family gives two numbers per (copy, k-mer): ``h``, whose trailing zero
count is the sampling level, and ``u`` (32 bits), split into column and
fingerprint. ``xxhash64`` is the production family. ``multiply`` takes the
same ``h`` and draws ``u`` from a seeded two-universal family, an odd multiple
and a sum modulo 2**64. ``md5`` gives the same values in any SQL engine and is
there for cross-checks. ``hash_arrays`` has the first two over NumPy arrays.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LEVEL = 63
REHASH = 117
COPY_STEP = 1_000_003


def level_of(h: Column) -> Column:
    """Trailing zeros of a non-negative BIGINT, 63 for zero.

    ``~h & (h - 1)`` keeps exactly the bits below the lowest set bit. It cannot
    overflow for h >= 0, which ``h & -h`` could under ANSI arithmetic.
    """
    below = F.bitwise_not(h).bitwiseAND(h - F.lit(1))
    return F.least(F.lit(MAX_LEVEL), F.bit_count(below)).cast("int")


def column_of(u: Column, r_exp: int, u_exp: int) -> Column:
    return F.shiftright(u, u_exp).bitwiseAND(F.lit((1 << r_exp) - 1))


def fingerprint_of(u: Column, u_exp: int) -> Column:
    return u.bitwiseAND(F.lit((1 << u_exp) - 1))


def xx_hash(words: list[str], copy: int, seed: int) -> Column:
    """63-bit hash of a k-mer; the leading literal seeds the chained hash."""
    start = F.lit(seed * COPY_STEP + copy).cast("bigint")
    return F.shiftrightunsigned(F.xxhash64(start, *[F.col(w) for w in words]), 1)


def xx_rehash(h: Column) -> Column:
    """32 bits that decide column and fingerprint, remixed from ``h``."""
    return F.shiftrightunsigned(F.xxhash64(h, F.lit(REHASH).cast("bigint")), 32)


def multiply_parameters(copy: int, seed: int) -> tuple[int, int]:
    """The odd factor and the summand of a copy, 64 bits each."""
    digest = hashlib.sha256(f"{seed}:{copy}".encode()).digest()
    return int.from_bytes(digest[:8], "big") | 1, int.from_bytes(digest[8:16], "big")


def multiply_rehash(h: Column, factor: tuple[Column, Column], summand: tuple[Column, Column]) -> Column:
    """The upper half of ``factor * h + summand`` modulo 2**64, for 0 <= h < 2**63.

    Factor and summand come as (upper, lower) halves. The product is put
    together from limbs, none of which overflows: under ANSI arithmetic a
    BIGINT product that wraps around is an error.
    """
    (up, down), (add_up, add_down) = factor, summand
    whole, half = F.lit((1 << 32) - 1), F.lit((1 << 16) - 1)
    lower, upper = h.bitwiseAND(whole), F.shiftright(h, 32)
    first, second = lower.bitwiseAND(half), F.shiftright(lower, 16)
    carry = F.shiftright(down * second + F.shiftright(down * first + add_down, 16), 16)
    crossed = up * first + F.shiftleft((up * second).bitwiseAND(half), 16)
    return (carry + crossed + (down * upper).bitwiseAND(whole) + add_up).bitwiseAND(whole)


def skipped(copy: Column, h: Column, skip: dict[int, list[int]]) -> Column:
    """Whether the hash falls on a level its copy leaves out."""
    out = F.lit(False)
    for c, levels in skip.items():
        out = out | ((copy == c) & level_of(h).isin(levels))
    return out


def hashed_rows(kmers, words, copies, seed, skip, keep, rehash) -> DataFrame:
    """One row ``(copy, h, u)`` per copy, but for the levels in ``skip``.

    The level test is a plain filter over all copies, evaluated before rows
    are multiplied: where the low levels are left out, nearly every k-mer is
    dropped without ever being exploded.
    """
    hashes = [xx_hash(words, c, seed) for c in range(copies)]
    if skip:
        wanted = F.lit(False)
        for c, h in enumerate(hashes):
            wanted = wanted | ~level_of(h).isin(skip.get(c, []))
        kmers = kmers.where(wanted)
    rows = kmers.select(F.posexplode(F.array(*hashes)).alias("copy", "h"), *keep)
    if skip:
        rows = rows.where(~skipped(F.col("copy"), F.col("h"), skip))
    return rows.select("copy", "h", rehash.alias("u"), *keep)


def hash_with_xx(kmers, words, copies, seed, skip, keep) -> DataFrame:
    return hashed_rows(kmers, words, copies, seed, skip, keep, xx_rehash(F.col("h")))


def hash_with_multiply(kmers, words, copies, seed, skip, keep) -> DataFrame:
    drawn = [multiply_parameters(c, seed) for c in range(copies)]

    def halves(which: int) -> tuple[Column, Column]:
        parts = ([d[which] >> 32 for d in drawn], [d[which] & ((1 << 32) - 1) for d in drawn])
        return tuple(F.array(*[F.lit(x).cast("bigint") for x in part])[F.col("copy")] for part in parts)

    return hashed_rows(kmers, words, copies, seed, skip, keep, multiply_rehash(F.col("h"), halves(0), halves(1)))


def hash_with_md5(kmers, words, copies, seed, skip, keep) -> DataFrame:
    """The same rows from the hex digits of ``md5(copy:kmer)``.

    ``h`` is hex digits 1-15 and ``u`` hex digits 17-24. The k-mer must be one
    string column; a seed other than 0 is put in front.
    """
    if len(words) != 1:
        raise ValueError("the md5 hash needs k-mers in one string column")
    prefix = "" if seed == 0 else f"{seed}:"
    rows = kmers.select(
        F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"),
        F.col(words[0]).cast("string").alias("kmer"),
        *keep,
    ).withColumn(
        "m", F.md5(F.concat(F.lit(prefix), F.col("copy").cast("string"), F.lit(":"), F.col("kmer")))
    )
    rows = rows.select(
        "copy",
        F.conv(F.substring("m", 1, 15), 16, 10).cast("bigint").alias("h"),
        F.conv(F.substring("m", 17, 8), 16, 10).cast("bigint").alias("u"),
        *keep,
    )
    if skip:
        rows = rows.where(~skipped(F.col("copy"), F.col("h"), skip))
    return rows


HASH_FAMILIES = {"xxhash64": hash_with_xx, "multiply": hash_with_multiply, "md5": hash_with_md5}
