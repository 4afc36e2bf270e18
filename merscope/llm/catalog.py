"""The operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merscope.llm import (
    chat_format,
    decontamination,
    exact_dedup,
    fill_in_middle,
    language_id,
    license_scan,
    minmax_dedup,
    ngram_join,
    packing,
    quality,
    sharding,
    spelling,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark, sf_dir):
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash", "hits")


@query
def op2_language_id(spark, sf_dir):
    return language_id.identify_documents(table(spark, sf_dir, "documents"))


@query
def op3_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicate_components(table(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query
def op6_sharding(spark, sf_dir):
    return sharding.document_shards(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    return str(public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op8_chat_format(spark, sf_dir):
    spoken = r"\### Assistant: </turn> ok"
    turns = [F.struct(F.lit(-7).cast("long"), F.lit(i).cast("long"), F.lit(r), F.lit(spoken)) for i, r in enumerate(["user", "assistant"])]
    more = spark.range(1).select(F.inline(F.array(*turns)).alias("conv_id", "turn", "role", "text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.format_digest(rows.unionByName(more))


@query
def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query
def op10_quality(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_minhash_dedup(spark, sf_dir):
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op12_fill_in_middle(spark, sf_dir):
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


@query
def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
