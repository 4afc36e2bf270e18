"""Bounded samples of documents to fit models on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lowest_hashes(rows: DataFrame, most: int, salt: str) -> DataFrame:
    """At most ``most`` distinct rows, those whose ``doc_id`` hashes lowest: the same on every run."""
    known = rows.where(F.col("doc_id").isNotNull()).distinct()
    return known.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(most)


def label_rows(labels: DataFrame, label: str) -> DataFrame:
    """``(doc_id, label)``, once per id; the larger label where rows disagree, nulls left out."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def with_columns_of(docs: DataFrame, sample: DataFrame, columns: list[str]) -> DataFrame:
    """The sampled rows with columns of their documents, one document an id.

    The sample is of bounded size by its making, so it is broadcast and the
    documents stay where they are. Of the documents that share an id the one
    whose columns hash lowest is taken, in each task before the shuffle, so
    that there are never more rows than in the sample.
    """
    found = docs.select("doc_id", *columns).join(F.broadcast(sample), "doc_id")
    one = F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("one")
    return found.groupBy(*sample.columns).agg(one).select(*sample.columns, "one.*")
