"""Near-duplicate detection by min-max hashing.

Each of ``PERMUTATIONS`` permutations of the 64-bit shingle hashes gives two
values of a set, its smallest and its largest element under it. Two sets agree
in either with a chance equal to their Jaccard similarity, and the two are
negatively correlated, so that their mean is an unbiased estimate of lower
variance than that of as many minima alone, at half the evaluations. The
values are cut into ``BANDS`` bands of values of different permutations; sets
that agree in a whole band are candidates, and whole sets decide. Many sets
can agree in a band and yet not link, as those of pages of one template; in
such a crowded bucket only mates that also share a shingle rare among them, as
any two that link must, are compared.

A pair right at the threshold agrees in no band with a chance of
(1 - 0.8 ** ROWS) ** BANDS = 1.2e-7, and has fewer than ``LEAST_AGREEING``
equal values with one below 1e-10; more similar pairs are missed less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merscope.llm.batches import small_batches
from merscope.llm.components import components, near_labels
from merscope.llm.ngram_join import dense_entries, remaining_dense_pairs
from merscope.llm.ngram_join import hub_pairs as hubs_of_shingles
from merscope.llm.scratch import saved
from merscope.llm.shingles import mix, shingle_sets

# Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
PERMUTATIONS = 100
ROWS = 5
BANDS = 2 * PERMUTATIONS // ROWS
# Of the 2 * PERMUTATIONS values, how many must be equal for whole sets to be compared.
LEAST_AGREEING = 120
# A bucket that is open after the first round and has more sets than this is crowded.
CROWD = 16
# Shingles worked on at a time: they stay in the CPU's cache over all permutations.
STEP = 1 << 15
# Ids whose broadcast is allowed: 8 MB.
MOST_BROADCAST = 1_000_000

FACTORS = np.random.default_rng(80).integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = np.random.default_rng(81).integers(0, 1 << 63, PERMUTATIONS, np.uint64)
MEASURES = "n bigint, sig_a bigint, sig_b bigint, bands array<bigint>, sketch binary"


def extremes(sets: list[np.ndarray]) -> np.ndarray:
    """``(set, 2 * PERMUTATIONS)``: minima, then maxima, of the non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    low = np.full((PERMUTATIONS, len(sets)), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros((PERMUTATIONS, len(sets)), np.uint64)
    for at in range(0, len(flat), STEP):
        part = flat[at : at + STEP]
        first = int(np.searchsorted(starts, at, "right")) - 1
        last = int(np.searchsorted(starts, at + len(part), "left"))
        begins = np.maximum(starts[first:last] - at, 0)
        moved = np.empty_like(part)
        for p in range(PERMUTATIONS):
            np.multiply(part, FACTORS[p], out=moved)
            np.add(moved, OFFSETS[p], out=moved)
            np.minimum(low[p, first:last], np.minimum.reduceat(moved, begins), out=low[p, first:last])
            np.maximum(high[p, first:last], np.maximum.reduceat(moved, begins), out=high[p, first:last])
    return np.concatenate([low, high]).T


def band_keys(values: np.ndarray) -> np.ndarray:
    """``(set, BANDS)``: one number for the values of each band.

    Band b holds the values b, b + BANDS, b + 2 * BANDS, ..., which are of
    different permutations.
    """
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(values), BANDS))
    for row in range(ROWS):
        keys = mix(keys * np.uint64(3) + values[:, row * BANDS : (row + 1) * BANDS])
    return keys


def groups(sets: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The sets in lists of about ``STEP`` shingles."""
    group, size = [], 0
    for found in sets:
        group.append(found)
        size += len(found)
        if size >= STEP:
            yield group
            group, size = [], 0
    if group:
        yield group


def measured_sets(docs: DataFrame) -> DataFrame:
    """``doc_id``; size and 128-bit signature of the shingle set; its band keys and one byte of each value."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in groups(shingle_sets(batch.column(1))):
                full = [s for s in group if len(s)]
                values = extremes(full) if full else np.zeros((0, 2 * PERMUTATIONS), np.uint64)
                keys = band_keys(values).view(np.int64).ravel()
                sketches = iter((values & np.uint64(255)).astype(np.uint8))
                widths = [BANDS if len(s) else 0 for s in group]
                columns = [
                    batch.column(0).slice(at, len(group)),
                    pa.array([len(s) for s in group], pa.int64()),
                    pa.array(np.array([s.sum(dtype=np.uint64) for s in group], np.uint64).view(np.int64)),
                    pa.array(np.array([mix(s + np.uint64(1)).sum(dtype=np.uint64) for s in group], np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(np.cumsum([0, *widths]).astype(np.int32), pa.array(keys)),
                    pa.array([next(sketches).tobytes() if len(s) else b"" for s in group], pa.binary()),
                ]
                at += len(group)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "sig_a", "sig_b", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {id_type}, {MEASURES}")


def can_link(n_a: str, n_b: str):
    return 100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)


def buckets(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(key, rep, n)`` of the bands that several sets have, and ``(key, hub, hub_n)`` of each such band.

    Bands of one set alone, which most are, go by a count that is combined
    before its shuffle. What is left is written, as a join with plain tables
    is one that Spark splits where a bucket is large.
    """
    entries = reps.select("rep", "n", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("rep", "n")).alias("hub"))
    hubs = saved(shared.where("many > 1").select("key", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")))
    return saved(entries.join(hubs.select("key"), "key")), hubs


def hub_pairs(entries: DataFrame, hubs: DataFrame) -> DataFrame:
    """Each set with the first of each of its buckets: one pair an entry, however large the bucket."""
    pairs = entries.join(hubs, "key").where((F.col("rep") != F.col("hub")) & can_link("n", "hub_n"))
    return pairs.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()


def open_buckets(entries: DataFrame, hubs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(key, rep, n, comp, major, size)`` of the buckets with sets of several components.

    A bucket whose sets all are in one component, as those of near copies, is
    left out as a whole. ``major`` is the largest component of a bucket; its
    hub has met all of its sets and is left out.
    """
    own = saved(
        entries.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("comp", F.coalesce("component", "rep"))
        .drop("component")
    )
    parts = own.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("many"))
    mixed = saved(
        parts.groupBy("key")
        .agg(F.max(F.struct("many", "comp")).alias("top"), F.sum("many").alias("size"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1")
        .select("key", F.col("top.comp").alias("major"), "size")
    )
    return saved(own.join(mixed, "key").join(hubs, "key").where("rep <> hub").drop("hub", "hub_n"))


def open_pairs(rest: DataFrame) -> DataFrame:
    """Pairs of mates of different components in buckets that are not crowded.

    The sets outside the largest component meet those of other components.
    """
    few = rest.where(F.col("size") <= CROWD)
    left = few.where("comp <> major").select("key", F.col("rep").alias("rep_a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a"))
    right = few.select("key", "major", F.col("rep").alias("rep_b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
    once = (F.col("comp_b") == F.col("major")) | (F.col("rep_a") < F.col("rep_b"))
    pairs = left.join(right, "key").where((F.col("comp_a") != F.col("comp_b")) & once & can_link("n_a", "n_b"))
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def band_mates(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs that agree in a band."""
    sides = [reps.select(F.col("rep").alias(s), F.col("bands").alias(f"bands_{s}")) for s in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    return joined.where(F.arrays_overlap("bands_a", "bands_b")).select("a", "b").distinct()


def crowded_links(rest: DataFrame, reps: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """Links between mates of crowded buckets that are still apart.

    The shingles of their sets are ordered by how many of these sets have
    them, rarest first. Two sets that link share one so early in that order
    that the rest leaves room for the overlap, whatever else they share. Each
    set first meets the one of fewest rarer shingles of each such shingle,
    then those that are still apart after that meet.
    """
    ids = saved(rest.where(F.col("size") > CROWD).select(F.col("rep").alias("doc_id")).distinct())
    entries = dense_entries(docs, ids, PERCENT)
    early = linked(band_mates(hubs_of_shingles(entries, True, PERCENT).distinct(), reps), reps, docs)
    now = saved(near_labels(first.union(early)))
    late = linked(band_mates(remaining_dense_pairs(entries, now, PERCENT).distinct(), reps), reps, docs)
    return early.union(late)


def estimated_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal values: an unbiased estimate of the Jaccard similarity of two non-empty sets."""
    return float(np.mean(a == b))


@F.pandas_udf(T.BooleanType())
def sketches_allow(sketch_a: pd.Series, sketch_b: pd.Series) -> pd.Series:
    a, b = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), 2 * PERMUTATIONS) for s in (sketch_a, sketch_b))
    return pd.Series((a == b).sum(axis=1) >= LEAST_AGREEING)


@F.pandas_udf(T.BooleanType())
def sets_link(set_a: pd.Series, set_b: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(set_a, set_b, strict=True):
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        shared = len(np.intersect1d(x, y, assume_unique=True))
        out.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
    return pd.Series(out, dtype=bool)


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(rep, set)``: the whole sorted sets of the documents in ``ids``, 8 bytes a shingle."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in groups(shingle_sets(batch.column(1))):
                packed = pa.array([s.tobytes() for s in group], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), packed], ["rep", "set"])
                at += len(group)

    few = ids.count() <= MOST_BROADCAST
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return texts.mapInArrow(measure, f"rep {id_type}, set binary")


def linked(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` that link: estimates rule most others out, whole sets decide."""
    sides = [reps.select(F.col("rep").alias(s), F.col("sketch").alias(f"sketch_{s}")) for s in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    likely = saved(joined.where(sketches_allow("sketch_a", "sketch_b")).select("a", "b"))
    ids = saved(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = saved(full_sets(docs, ids).distinct())
    parts = [sets.select(F.col("rep").alias(s), F.col("set").alias(f"set_{s}")) for s in "ab"]
    both = likely.join(parts[0], "a").join(parts[1], "b")
    return saved(both.where(sets_link("set_a", "set_b")).select(F.col("a").alias("u"), F.col("b").alias("v")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Documents of equal sets are one class with the smallest id as its node; no
    pairs are made within it. Candidates are verified in two rounds: first
    each set with the first of each of its buckets, which joins groups of near
    copies without their pairs, then the bucket mates that are still apart,
    in crowded buckets those that share a rare shingle.
    Texts without words, and null texts, have no shingles and are linked with
    nothing. A null id has no component, links nothing and is kept; rows that
    share an id are one document and link by the text of any of them. An
    empty table gives no rows. Other columns are not read.
    """
    with small_batches(docs.sparkSession):
        measured = saved(measured_sets(docs))
        key = ["n", "sig_a", "sig_b"]
        linkable = measured.where("n > 0 AND doc_id IS NOT NULL")
        chosen = linkable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first(F.struct("bands", "sketch")).alias("own"))
        reps = saved(chosen.select(*key, "rep", "own.*"))
        texts = docs.where(F.col("doc_id").isNotNull())
        entries, hubs = buckets(reps)
        first = linked(hub_pairs(entries, hubs), reps, texts)
        labels = saved(near_labels(first))
        rest = open_buckets(entries, hubs, labels)
        crowded = crowded_links(rest, reps, texts, first)
        found = components(first.union(linked(open_pairs(rest), reps, texts)).union(crowded))
        classes = saved(
            reps.select(*key, "rep")
            .join(found.withColumnRenamed("node", "rep"), "rep", "left")
            .select(*key, F.coalesce("component", "rep").alias("component"))
        )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        measured.select("doc_id", *key)
        .join(classes, key, "left")
        .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    gone = saved(near_duplicates(docs).where("NOT kept").select("doc_id").distinct())
    few = gone.count() <= MOST_BROADCAST
    rest = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])
