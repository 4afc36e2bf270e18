"""Exact deduplication by a 128-bit content hash, checked against the bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merscope.llm.scratch import saved

# Keys whose broadcast is allowed.
MOST_BROADCAST = 1_000_000


def collapse_space(text: Column) -> Column:
    """The text with each run of ASCII white space replaced by one space.

    Null counts as empty. A run that is one space already is left alone, so
    the pattern names the other runs only.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def content_hash(text: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(text))


def groups_of_equal_text(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text: ``(hash, sha256, keep_id, group_size)``.

    Rows meet by hash; the text itself is part of the grouping key, so Spark
    compares the bytes of texts that share a hash and a collision gives two
    groups. Copies are combined before the shuffle: a text that a third of
    all rows share leaves each task as one row.
    """
    norm = docs.select(F.col("doc_id"), collapse_space(F.col("text")).alias("norm"))
    return (
        norm.groupBy(content_hash(F.col("norm")).alias("hash"), F.col("norm"))
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash", F.sha2("norm", 256).alias("sha256"), "keep_id", "group_size")
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: which document of its group stays.

    Columns ``doc_id, keep_id, group_size, kept, text_sha256``. Null text is
    empty text; the empty texts form a group. The smallest non-null id stays;
    if every id of a group is null, ``keep_id`` is null and its rows are kept.
    Repeated rows with one id and text are one document: all say the same.
    An empty table gives no rows; other columns of the input are not read.
    """
    norm = docs.select(F.col("doc_id"), collapse_space(F.col("text")).alias("norm"))
    keys = norm.select("doc_id", content_hash(F.col("norm")).alias("hash"), F.sha2("norm", 256).alias("sha256"))
    return keys.join(groups_of_equal_text(docs), ["hash", "sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns, each of them once.

    Copies go wherever ``exact_groups`` says ``kept = false``; repeated rows
    of the document that stays are reduced to one. It is decided on ids and
    hashes. Only the rows of groups of two or more are looked at, and only the
    keys of those that go are joined to the documents, by a broadcast while
    they are few; a document that has no copy is moved nowhere.
    """
    groups = saved(groups_of_equal_text(docs).where("group_size > 1").select("hash", "sha256", "keep_id"))
    norm = collapse_space(F.col("text"))
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keys = docs.select(F.col("doc_id").alias("id"), own.alias("own"), content_hash(norm).alias("hash"), F.sha2(norm, 256).alias("sha256"))
    copies = keys.join(groups, ["hash", "sha256"])
    counted = copies.groupBy("hash", "sha256", "id", "own", "keep_id").agg(F.count(F.lit(1)).alias("many"))
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    # Rows of the document that stays may differ in white space; they are one group of rows.
    marked = saved(counted.select("id", "own", "hash", "sha256", stays.alias("stays"), "many"))
    again = marked.where("stays").groupBy("hash", "sha256", "id").agg(F.sum("many").alias("many")).where("many > 1")
    again = saved(marked.where("stays").join(again.select("hash", "sha256", F.col("id").alias("same")), ["hash", "sha256"])
                  .where(F.col("id").eqNullSafe(F.col("same"))).select("id", "own", "hash", "sha256").distinct())
    gone = saved(marked.where("NOT stays").select("id", "own").union(again.select("id", "own")).distinct())

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("row_id"), own.alias("row_own"))
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_own") == F.col("own"))

    def keyed(few: DataFrame) -> DataFrame:
        return F.broadcast(few) if few.count() <= MOST_BROADCAST else few

    rest = rows.join(keyed(gone), same, "left_anti").select("doc")
    one = rows.join(keyed(again), same).dropDuplicates(["hash", "sha256", "row_id"]).select("doc")
    return rest.unionByName(one).select("doc.*")
