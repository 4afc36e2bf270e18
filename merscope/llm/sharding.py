"""Shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A hex digit more or less of the md5 is 16 times the buckets.
BUCKET_DIGITS = 3
ROUNDS = 4
# Steps of cycle walking written into the expression. A step leaves the range
# with a chance of about 2 / sqrt(rows), and rows below this number have fewer
# values outside the range than there are steps.
WALKS = 64


def numbered(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Adds ``number``, gapless from 0, and ``total``, the row count.

    Rows are ordered by a bucket of the key's md5 and within it by ``order``.
    Only the count of each of the 16**3 buckets is gathered and broadcast, a
    table whose size is fixed; no task sees more than its buckets.
    """
    bucketed = rows.withColumn("bucket", F.substring(F.md5(key), 1, BUCKET_DIGITS))
    counts = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select(
        F.col("bucket"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.sum("n").over(everything).alias("total"),
    )
    within = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return (
        bucketed.withColumn("within", within)
        .join(F.broadcast(starts), "bucket")
        .withColumn("number", F.col("first") + F.col("within") - 1)
        .drop("bucket", "within", "first")
    )


def round_value(right: Column, turn: Column, seed: int) -> Column:
    """The round function: the first 48 bits of an md5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), right.cast("string"))), 1, 12)
    return F.conv(digits, 16, 10).cast("long")


def feistel(value: Column, side: Column, seed: int) -> Column:
    """A permutation of 0 .. side * side - 1, by rounds on two digits of base ``side``."""
    halves = F.struct(F.floor(value / side).cast("long").alias("l"), F.pmod(value, side).alias("r"))
    mixed = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        halves,
        lambda s, turn: F.struct(s["r"].alias("l"), F.pmod(s["l"] + round_value(s["r"], turn, seed), side).alias("r")),
    )
    return F.aggregate(F.array(mixed), F.lit(0).cast("long"), lambda _, s: s["l"] * side + s["r"])


def permuted(number: Column, total: Column, seed: int) -> Column:
    """The place of a row number in the seeded shuffle of 0 .. total - 1.

    The permutation acts on the smallest square that holds ``total`` values;
    a value outside the range is permuted again until it falls inside (cycle
    walking), which keeps the map one-to-one. Should it still be outside after
    ``WALKS`` steps, the query fails rather than give a wrong place.
    """
    side = F.ceil(F.sqrt(total)).cast("long")
    place = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)),
        feistel(number, side, seed),
        lambda at, _: F.when(at < total, at).otherwise(feistel(at, side, seed)),
    )
    landed = F.aggregate(F.array(place), F.lit(0).cast("long"), lambda _, at: F.coalesce(F.when(at < total, at), F.raise_error(F.lit("the walk did not end")).cast("long")))
    return landed


def assign_shards(rows: DataFrame, key: Column, order: list[str], shards: int = 8, seed: int = 17) -> DataFrame:
    """Adds ``shard`` and ``slot``; shard sizes in rows differ by one at most.

    A row at place p of the shuffle is in shard p mod ``shards`` at slot
    p div ``shards``, so both can be computed from its row number alone.
    """
    placed = numbered(rows, key, order).withColumn("place", permuted(F.col("number"), F.col("total"), seed))
    return placed.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
    )


def document_shards(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``law`` is ``rows``. Null text has no bytes. Rows with a null id are told
    apart by their text; rows alike in id and text are interchangeable. An
    empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("text_crc32").cast("string")))
    return assign_shards(rows, key, ["doc_id", "text_crc32", "size"], shards, seed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
