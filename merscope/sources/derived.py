"""Sequences derived from ordinary tables.

The query catalog runs on business tables, which hold no DNA. A row's keys are
turned into bases through the hex digits of their md5, a rule any SQL engine
can repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merscope.sources.spread import spread

# Bases for the 16 hex digits, with and without an ambiguous one.
HEX = "0123456789abcdef"
WITH_N = "ACGTACGTACGTACGN"
PURE = "ACGTACGTACGTACGT"


def digest(prefix: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(prefix), F.col(key).cast("string")))


def bases_of(*digests: Column, letters: str = WITH_N) -> Column:
    return F.translate(F.concat(*digests), HEX, letters)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))


def lineitem_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 64-symbol read per line item; many items share a read."""
    rows = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey")
    return rows.select(bases_of(digest("", "l_partkey"), digest("s", "l_suppkey")).alias("seq"))


def orders_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 64-symbol read per order."""
    rows = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    return rows.select(bases_of(digest("c", "o_custkey"), digest("o", "o_orderkey")).alias("seq"))


def long_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 96-base read per line item, without ambiguous symbols."""
    rows = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey")
    parts = [digest("", "l_partkey"), digest("s", "l_suppkey"), digest("p", "l_partkey")]
    return rows.select(bases_of(*parts, letters=PURE).alias("seq"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts taken as sequences: mostly bytes that are no bases."""
    return table(spark, sf_dir, "documents", "text").select(F.col("text").alias("seq"))


def event_reads(events: DataFrame) -> DataFrame:
    """One 64-symbol read per event."""
    return events.select(bases_of(digest("", "user_id"), digest("e", "event_type")).alias("seq"))
