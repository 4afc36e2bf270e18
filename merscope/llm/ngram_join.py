"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Shingles are ordered by hash. Two texts at or above the threshold share at
least l of the first ``prefix(n, l)`` shingles of each, for every l. A text
whose prefix holds shingles that many texts share lengthens it until, of the
l that have to match, fewer than l can be such hot ones; the others alone
then find its partners, and at least so many have to match before a pair is
verified. Texts made of hot shingles all through are few; their whole sets are
counted, and they look for each other by their rarest shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merscope.llm.batches import frees_memory, small_batches
from merscope.llm.components import components, near_labels
from merscope.llm.scratch import saved
from merscope.llm.shingles import mix, shingle_sets

# Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
# A shingle in this many texts' heads or more is hot.
HOT = 24
# Weight of verifying a candidate against reading an entry of a list.
VERIFY_COST = 8.0
# Ids whose broadcast is allowed: 8 MB.
MOST_BROADCAST = 1_000_000
SET_BYTES = 6


def least_overlap(n):
    """Shingles that a set of n shares at least with any partner."""
    return -(-PERCENT * n // 100)


def spare(n):
    """Shingles of the head beyond the plain prefix; never fewer for a larger set."""
    return 4 + n // 40


def prefix(n, level):
    return n - least_overlap(n) + level


def head_length(n):
    return np.minimum(n, prefix(n, 1) + spare(n))


def highest_level(n):
    """Largest level for which every possible partner has a long enough head and set."""
    smallest = least_overlap(n)
    return np.minimum(1 + spare(smallest), least_overlap(smallest))


# As an object, since text would need a session when this module is imported.
LEVELS = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("required", T.IntegerType())])
FEATURES = "n bigint, sig_a bigint, sig_b bigint, head array<bigint>"


def features(docs: DataFrame) -> DataFrame:
    """``doc_id``, size and 128-bit signature of the shingle set, and the head of it in hash order."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    @frees_memory
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, heads = [], [], [], []
            for found in shingle_sets(batch.column(1)):
                n.append(len(found))
                a.append(found.sum(dtype=np.uint64))
                b.append(mix(found + np.uint64(1)).sum(dtype=np.uint64))
                heads.append(found[: int(head_length(len(found)))])
            columns = [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(np.array(a, np.uint64).view(np.int64)),
                pa.array(np.array(b, np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(
                    np.cumsum([0, *map(len, heads)]).astype(np.int32),
                    pa.array(np.concatenate([*heads, np.zeros(0, np.uint64)]).view(np.int64)),
                ),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "sig_a", "sig_b", "head"])

    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {id_type}, {FEATURES}")


def choose_levels(n: int, at: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
    """Level of a text and how many non-hot shingles have to match; (0, 0) if hot all through.

    ``at`` are the places in the head of the shingles that other heads have
    too, ``counts`` how many heads have each. Of the levels at which some
    non-hot shingle has to match, the cheapest is taken: the entries to read
    and the candidates to verify, which fall as more have to match.
    """
    best = (np.inf, 0, 0)
    hot = counts >= HOT
    for level in range(1, int(highest_level(n)) + 1):
        near = at < prefix(n, level)
        required = level - int(np.count_nonzero(hot & near))
        if required >= 1:
            entries = float((counts - 1)[near & ~hot].sum())
            cost = entries + VERIFY_COST * entries / required**2
            if cost < best[0]:
                best = (cost, level, required)
            if required >= 3:
                break
    return best[1], best[2]


@F.pandas_udf(LEVELS)
def level_of(n: pd.Series, at: pd.Series, counts: pd.Series) -> pd.DataFrame:
    found = [choose_levels(*x) for x in zip(n, at, counts, strict=True)]
    return pd.DataFrame(found, columns=["level", "required"])


def shared_tokens(posted: DataFrame) -> DataFrame:
    """``(token, cnt)`` of the shingles that more than one text has.

    Written, as are the other tables with one row a list: a join with a plain
    table is one that Spark splits where a list is long, or broadcasts when
    the table is small; one with an aggregate in place is neither.
    """
    return saved(posted.groupBy("token").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1"))


def index_entries(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index ``(token, rep, n, pos, level, required)`` of shingles that are not
    hot, and the ids of the texts hot all through, whose level is 0.

    Shingles that only one head has are dropped first, by a count combined
    before its shuffle; nearly all are. What is left is levelled by text.
    """
    posted = reps.select("rep", "n", F.posexplode("head").alias("pos", "token"))
    known = saved(posted.join(shared_tokens(posted), "token"))
    by_text = known.groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "cnt"))).alias("found"))
    levels = by_text.select("rep", "n", level_of(F.col("n"), F.col("found.pos"), F.col("found.cnt")).alias("l")).select(
        "rep", "n", "l.level", "l.required"
    )
    overlap = F.floor((F.lit(PERCENT) * F.col("n") + 99) / 100)
    own_prefix = F.col("n") - overlap + F.col("level")
    emitted = (F.col("cnt") < HOT) & ((F.col("level") == 0) | (F.col("pos") < own_prefix))
    placed = saved(known.join(levels, ["rep", "n"]))
    hot_through = saved(placed.where("level = 0").select(F.col("rep").alias("doc_id")).distinct())
    return placed.where(emitted).drop("cnt"), hot_through


def dense_entries(docs: DataFrame, ids: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(token, rep, n, pos, indexed)`` of the plain prefixes of the texts in ``ids``, such as those hot all through.

    Their whole sets are ordered by how many of these texts have a shingle,
    rarest first; ``pos`` is the place in that order. Shingles that one text
    alone has take their places but make no entries. The first shared shingle
    of a pair that links is ``indexed`` on the side of the smaller set: it is
    early enough for a partner of the text's own size. A list without an
    indexed entry finds nothing and is left out; texts of one template, whose
    own shingles fill these places, so have no lists to meet in.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    @frees_memory
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.view(np.int64) for s in shingle_sets(batch.column(1))]
            columns = [batch.column(0), pa.array(list(map(len, found)), pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "n", "tokens"])

    texts = with_ids(docs, ids, "left_semi").select("doc_id", "text")
    sets = texts.mapInArrow(measure, f"rep {id_type}, n bigint, tokens array<bigint>")
    posted = saved(sets.select("rep", "n", F.explode("tokens").alias("token")))
    known = posted.join(shared_tokens(posted), "token")
    own = Window.partitionBy("rep", "n")
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("cnt", "token")) - 1
    overlap = F.floor((F.lit(percent) * F.col("n") + 99) / 100)
    early = F.col("pos") <= F.col("n") - overlap_of(F.col("n"), F.col("n"), percent)
    placed = saved(known.withColumn("pos", place).where(F.col("pos") <= F.col("n") - overlap).drop("cnt").withColumn("indexed", early))
    return saved(placed.join(saved(placed.where("indexed").select("token").distinct()), "token"))


def overlap_of(n_a: Column, n_b: Column, percent: int = PERCENT) -> Column:
    """Shingles that two sets of these sizes share at least if they link."""
    return F.floor((F.lit(percent) * (n_a + n_b) + 99 + percent) / (100 + percent))


def can_link(n_a: Column, n_b: Column, percent: int = PERCENT) -> Column:
    return (100 * F.least(n_a, n_b)) >= (percent * F.greatest(n_a, n_b))


def room_for_overlap(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column, percent: int = PERCENT) -> Column:
    """Whether two texts can link if their first shared shingle is at these places.

    It holds for the first one of any pair that links, so a pair for which it
    fails at each shared shingle cannot link.
    """
    return can_link(n_a, n_b, percent) & (F.least(n_a - pos_a, n_b - pos_b) >= overlap_of(n_a, n_b, percent))


def hub_pairs(entries: DataFrame, by_place: bool = False, percent: int = PERCENT) -> DataFrame:
    """Each text with one text of each of its lists: one pair an entry, however long the list.

    That is the text of the smallest id or, with ``by_place``, the one that has
    the fewest rarer shingles: of a group of near copies the one with fewest changes.
    """
    fields = ("pos", "rep", "n") if by_place else ("rep", "n", "pos")
    hubs = saved(entries.groupBy("token").agg(F.min(F.struct(*fields)).alias("hub")))
    n, hub_n = F.col("n"), F.col("hub.n")
    able = room_for_overlap(n, F.col("pos"), hub_n, F.col("hub.pos"), percent) if by_place else can_link(n, hub_n, percent)
    pairs = entries.join(hubs, "token").where((F.col("rep") != F.col("hub.rep")) & able)
    return pairs.select(F.least("hub.rep", "rep").alias("a"), F.greatest("hub.rep", "rep").alias("b"))


def open_pairs(entries: DataFrame, found: DataFrame, able: Column, by_index: bool = False) -> DataFrame:
    """All pairs of list mates that are ``able`` and not in one component yet.

    Lists whose texts all are in one component, as those of a group of near
    copies, are left out as a whole. In the others the texts outside the
    list's largest component meet all texts of other components. Columns of
    the two sides end in ``_a`` and ``_b``. With ``by_index`` one of the two
    has to be ``indexed``.
    """
    parts = entries.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    own = saved(parts.withColumn("comp", F.coalesce("component", "rep")).drop("component"))
    sizes = own.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("many"))
    mixed = saved(
        sizes.groupBy("token")
        .agg(F.max(F.struct("many", "comp")).alias("top"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1")
        .select("token", F.col("top.comp").alias("major"))
    )
    open_lists = saved(own.join(mixed, "token"))
    columns = [c for c in own.columns if c != "token"]
    left = open_lists.where("comp <> major").select("token", *[F.col(c).alias(f"{c}_a") for c in columns])
    right = open_lists.select("token", "major", *[F.col(c).alias(f"{c}_b") for c in columns])
    once = (F.col("comp_b") == F.col("major")) | (F.col("rep_a") < F.col("rep_b"))
    if by_index:
        met = left.where("indexed_a").join(right, "token").unionByName(left.where("NOT indexed_a").join(right.where("indexed_b"), "token"))
    else:
        met = left.join(right, "token")
    return met.where((F.col("comp_a") != F.col("comp_b")) & once & able)


def remaining_pairs(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates of the index that are still apart and match often enough at the pair's level."""
    level_a, level_b = F.col("level_a"), F.col("level_b")
    level = F.when(level_a == 0, level_b).when(level_b == 0, level_a).otherwise(F.least(level_a, level_b))
    required = F.when(level_a == level, F.col("required_a")).otherwise(F.col("required_b"))

    def in_prefix(side: str) -> Column:
        n = F.col(f"n_{side}")
        return F.col(f"pos_{side}") < n - F.floor((F.lit(PERCENT) * n + 99) / 100) + level

    able = can_link(F.col("n_a"), F.col("n_b")) & (level > 0) & in_prefix("a") & in_prefix("b")
    counted = open_pairs(entries, found, able).select(*pair_columns(), required.alias("required"))
    matched = counted.groupBy("a", "b").agg(F.count(F.lit(1)).alias("matches"), F.min("required").alias("required"))
    return matched.where("matches >= required").select("a", "b")


def remaining_dense_pairs(entries: DataFrame, found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Candidates of ``dense_entries`` that are still apart."""
    able = room_for_overlap(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"), percent)
    return open_pairs(entries, found, able, by_index=True).select(*pair_columns())


def pair_columns() -> list[Column]:
    return [F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")]


def needed_overlap(n_a, n_b):
    return -(-PERCENT * (n_a + n_b) // (100 + PERCENT))


def possible(n_a: int, n_b: int, head_a: np.ndarray, head_b: np.ndarray) -> bool:
    """Whether the heads leave room for the overlap that a link needs; never wrongly no."""
    a, b = head_a.view(np.uint64), head_b.view(np.uint64)
    end = min(a[-1], b[-1])
    known_a, known_b = np.searchsorted(a, end, "right"), np.searchsorted(b, end, "right")
    shared = len(np.intersect1d(a[:known_a], b[:known_b], assume_unique=True))
    return shared + min(n_a - known_a, n_b - known_b) >= needed_overlap(n_a, n_b)


@F.pandas_udf(T.BooleanType())
def heads_allow(n_a: pd.Series, n_b: pd.Series, head_a: pd.Series, head_b: pd.Series) -> pd.Series:
    return pd.Series([possible(*x) for x in zip(n_a, n_b, head_a, head_b, strict=True)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def sets_link(set_a: pd.Series, set_b: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(set_a, set_b, strict=True):
        kind = np.dtype((np.void, SET_BYTES))
        x, y = np.frombuffer(a, kind), np.frombuffer(b, kind)
        shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
        out.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
    return pd.Series(out, dtype=bool)


def full_sets(docs: DataFrame) -> DataFrame:
    """``(rep, set)``: the whole sorted set, ``SET_BYTES`` of each hash."""

    @frees_memory
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [
                s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()
                for s in shingle_sets(batch.column(1))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["rep", "set"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(measure, f"rep {id_type}, set binary")


def with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on ``doc_id``: broadcast up to a bound, shuffled beyond it."""
    few = ids.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how).select(*[F.col(f"`{c}`") for c in docs.columns])


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that link: the heads rule most others out, whole sets decide."""
    heads = reps.select("rep", "n", "head")
    sides = [heads.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("head").alias(f"head_{s}")) for s in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    likely = saved(joined.where(heads_allow("n_a", "n_b", "head_a", "head_b")).select("a", "b"))
    ids = saved(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    # Written once, so that no task has workers for the sets of both sides and for the comparison.
    sets = saved(full_sets(with_ids(docs, ids, "left_semi")))
    parts = [sets.select(F.col("rep").alias(s), F.col("set").alias(f"set_{s}")) for s in "ab"]
    both = likely.join(parts[0], "a").join(parts[1], "b")
    return saved(both.where(sets_link("set_a", "set_b")).select(F.col("a").alias("u"), F.col("b").alias("v")))


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Texts of equal sets are one class with the smallest id as its node; no
    pairs are made within it. Candidates are verified in two rounds: first
    every text with the first of each list, which joins groups of near copies
    without their pairs, then all candidates that are still apart. Texts
    without words, and null texts, have no shingles and are linked with
    nothing. A null id has no component and links nothing; rows that share an
    id are one document. Other columns are not read.
    """
    key = ["n", "sig_a", "sig_b"]
    with small_batches(docs.sparkSession):
        measured = saved(features(docs))
        linkable = measured.where("n > 0 AND doc_id IS NOT NULL")
        reps = saved(linkable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("head").alias("head")))
        texts = docs.where(F.col("doc_id").isNotNull())
        entries, hot_through = index_entries(reps)
        dense = dense_entries(texts, hot_through)
        first = verified(hub_pairs(entries).union(hub_pairs(dense, by_place=True)).distinct(), reps, texts)
        joined = saved(near_labels(first))
        rest = remaining_pairs(entries, joined).union(remaining_dense_pairs(dense, joined)).distinct()
        found = components(first.union(verified(rest, reps, texts)))
    classes = reps.drop("head").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = classes.select(*key, F.coalesce("component", "rep").alias("component_id"))
    return (
        measured.drop("head")
        .join(named, key, "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest id, with its own columns."""
    found = near_duplicate_components(docs)
    gone = saved(found.where("doc_id <> component_id").select("doc_id").distinct())
    return with_ids(docs, gone, "left_anti")
