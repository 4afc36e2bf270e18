"""Packing of token pieces into sequences by linear grouping.

Only the number of pieces of each length, at most ``capacity`` numbers, is
gathered. On it the driver plans which ranks of a length go to which
sequences; each piece then looks its place up by its length and its rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merscope.llm.batches import bound_batches, frees_memory
from merscope.llm.scratch import saved
from merscope.llm.tokens import CachedEncoder

CAPACITY = 2048
# Pieces longer than capacity / parts are large and go into that many groups.
# Each pair is tried, on the counts alone, and the plan of fewest sequences kept.
SCHEMES = ((3, 64), (4, 200), (6, 128))
# Pieces of one length whose ranks are counted in one hash bucket, about.
PER_BUCKET = 1 << 18


# --- the plan: counts of lengths only -----------------------------------------


def equal_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Runs ``(length, count)`` in descending order, cut into groups of equal cardinality."""
    total = sum(counts.values())
    per_group = max(1, -(-total // groups))
    out, room = [[]], per_group
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
            if not room:
                out.append([])
                room = per_group
    return [g for g in out if g]


def best_configuration(sizes: list[int], value: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size so that the value in one sequence is greatest (a knapsack)."""
    best = np.zeros(capacity + 1)
    takes = np.zeros((len(sizes), capacity + 1), int)
    for k, size in enumerate(sizes):
        before = best.copy()
        for n in range(1, capacity // size + 1):
            offer = before[: -n * size] + n * value[k]
            better = offer > best[n * size :] + 1e-12
            best[n * size :][better] = offer[better]
            takes[k, n * size :][better] = n
    taken, room = np.zeros(len(sizes)), capacity
    for k in reversed(range(len(sizes))):
        taken[k] = takes[k, room]
        room -= sizes[k] * takes[k, room]
    return taken


def optimal_configurations(sizes: list[int], need: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, by the linear program of cutting stock.

    Columns are generated by the knapsack (Gilmore and Gomory) until none has
    a price above 1, which proves those in use optimal; there are as many as
    sizes. The needs are moved by less than a thousandth of a piece, each by
    another part of it, so that no step is empty and the steps do not go round.
    Should rounding errors let a configuration come back that is in use, it
    ends there too.
    """
    columns = np.diag([float(capacity // s) for s in sizes])
    moved = np.array(need, float) + 1e-3 * np.random.default_rng(7).random(len(sizes))
    used = moved / np.diag(columns)
    while True:
        price = np.linalg.solve(columns.T, np.ones(len(sizes)))
        fresh = best_configuration(sizes, price, capacity)
        if price @ fresh <= 1 + 1e-7 or (columns == fresh[:, None]).all(axis=0).any():
            break
        pace = np.linalg.solve(columns, fresh)
        limits = np.where(pace > 1e-9, used / np.where(pace > 1e-9, pace, 1), np.inf)
        out = int(np.argmin(limits))
        step = limits[out]
        used = np.maximum(used - step * pace, 0)
        columns[:, out], used[out] = fresh, step
    return [(columns[:, k], used[k]) for k in range(len(sizes))]


class Plan:
    """Where the pieces go: runs of ranks of one length to runs of sequences."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.left = dict(counts)
        self.rank = dict.fromkeys(counts, 0)
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int]] = []
        # Open sequences by free room, as runs (first, count); the rooms in order.
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def put(self, length: int, first: int, count: int, per_sequence: int, offset: int) -> None:
        """``per_sequence`` pieces of a length into each of ``count`` sequences, at ``offset``."""
        self.rows.append((length, self.rank[length], first, per_sequence, offset))
        self.rank[length] += count * per_sequence
        self.left[length] -= count * per_sequence

    def leave(self, room: int, first: int, count: int) -> None:
        """A run of sequences with that much room is open."""
        if room not in self.open:
            insort(self.rooms, room)
        self.open.setdefault(room, []).append((first, count))

    def fullest(self, length: int) -> tuple[int, int, int] | None:
        """Take a run ``(room, first, count)`` of the fullest sequences with room for a length."""
        at = bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, count = self.open[room].pop()
        if not self.open[room]:
            del self.open[room], self.rooms[at]
        return room, first, count

    def fill_configuration(self, groups: list[list[list[int]]], taken: np.ndarray, times: int) -> None:
        """Open ``times`` sequences of one configuration with actual pieces of its groups.

        Sequences that get the same lengths are opened as one run.
        """
        slots = [(k, int(n)) for k, n in enumerate(taken) if n and groups[k]]
        while times:
            run = min([times, *(groups[k][0][1] // n for k, n in slots if groups[k])])
            each, run = ([], run) if run else ([], 1)
            for k, n in slots:
                for _ in range(n):
                    if not groups[k]:
                        break
                    head = groups[k][0]
                    each.append(head[0])
                    head[1] -= run
                    if not head[1]:
                        groups[k].pop(0)
            if not each:
                return
            first, used = self.sequences, 0
            self.sequences += run
            for length in each:
                self.put(length, first, run, 1, used)
                used += length
            self.leave(self.capacity - used, first, run)
            times -= run

    def best_fit(self) -> None:
        """All that is left, longest first, each into the fullest sequence with room for it."""
        for length in sorted(self.left, reverse=True):
            while (n := self.left[length]) > 0:
                found = self.fullest(length)
                if found is None:
                    found = (self.capacity, self.sequences, -(-n // (self.capacity // length)))
                    self.sequences += found[2]
                room, first, count = found
                per, offset = room // length, self.capacity - room
                full = min(count, n // per)
                runs = [(full, per), (1, n - full * per)] if full < count and n > full * per else [(full, per)]
                for many, each in runs:
                    if many:
                        self.put(length, first, many, each, offset)
                        self.leave(room - each * length, first, many)
                        first, count = first + many, count - many
                if count:
                    self.leave(room, first, count)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The linear grouping scheme on the counts of lengths.

    Large lengths are sorted into groups of equal cardinality and rounded up
    to the longest of their group; the few sizes that remain give a small
    linear program, whose whole parts are used. Actual pieces take the places
    of the rounded ones, as they are no longer. What rounding leaves over and
    the small pieces follow by best fit.
    """
    return min((linear_grouping(counts, capacity, *scheme) for scheme in SCHEMES), key=lambda p: p.sequences)


def linear_grouping(counts: dict[int, int], capacity: int, parts: int, n_groups: int) -> Plan:
    plan = Plan(counts, capacity)
    large = {s: n for s, n in counts.items() if capacity // parts < s < capacity and n}
    if large:
        groups = equal_groups(large, n_groups)
        sizes = [g[0][0] for g in groups]
        merged: list[list[list[int]]] = []
        distinct: list[int] = []
        for size, group in zip(sizes, groups, strict=True):
            if distinct and distinct[-1] == size:
                merged[-1] += [list(run) for run in group]
            else:
                distinct.append(size)
                merged.append([list(run) for run in group])
        need = [sum(n for _, n in g) for g in merged]
        for taken, times in optimal_configurations(distinct, need, capacity):
            plan.fill_configuration(merged, taken, int(times + 1e-6))
    plan.best_fit()
    return plan


# --- Spark --------------------------------------------------------------------


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of each document, ``ids`` on request.

    A document's ids are the tokenizer's and a final 0; longer ones are cut
    into pieces of ``capacity``, the last may be shorter. Null text is empty.
    """
    bound_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    @frees_memory
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CachedEncoder(tokenizer)
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            found, borders = encoder.encode_column([text or "" for text in batch.column(1).to_pylist()])
            for row, (begin, end) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)):
                raw = found[begin:end].tobytes() + bytes(4)
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            columns = [
                batch.column(0).take(pa.array(rows, pa.int32())),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc)),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(cut, fields)


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds ``rank``, from 0, of each piece among those of its length.

    Ranks are counted in hash buckets, of which a length has as many as its
    count asks for, so that one that most pieces share is spread. The numbers
    of buckets and where each begins are broadcast: a row for each length and
    one for every ``PER_BUCKET`` pieces.
    """
    many = [(length, n // PER_BUCKET + 1) for length, n in counts.items()]
    buckets = pieces.sparkSession.createDataFrame(many, "length bigint, buckets bigint")
    place = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))
    keyed = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", place).drop("buckets")
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    return (
        keyed.withColumn("within", within)
        .join(F.broadcast(starts), ["length", "bucket"])
        .withColumn("rank", F.col("first") + F.col("within") - 1)
        .drop("bucket", "first", "within")
    )


def look_up(plan: Plan):
    """A pandas UDF from length and rank to ``struct<sequence_id, offset>``."""
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    length, rank, first, per, base = rows.T
    keys = length << 44 | rank

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        size, own = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        at = np.searchsorted(keys, size << 44 | own, side="right") - 1
        behind = own - rank[at]
        return pd.DataFrame({"sequence_id": first[at] + behind // per[at], "offset": base[at] + behind % per[at] * size})

    return place


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``.

    Within a sequence pieces stand gapless from 0. Texts are tokenized once;
    the pieces are kept in the shared scratch folder. Pieces that fill a
    sequence stay where they are. Null text is empty and
    gives the piece of a final 0; repeated rows and null ids are documents of
    their own; an empty table gives no rows; other columns are not read.
    """
    pieces = saved(token_pieces(docs, tokenizer, capacity, with_ids))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts.pop(capacity, None)
    plan = plan_packing(counts, capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    # A piece that fills a sequence needs no rank: any number of its own will do.
    own = F.lit(plan.sequences).cast("bigint") + F.monotonically_increasing_id()
    full = pieces.where(F.col("length") == capacity).select(*columns, own.alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    if not counts:
        return full
    shorter = ranked(pieces.where(F.col("length") < capacity), counts)
    placed = shorter.withColumn("place", look_up(plan)("length", "rank"))
    return placed.select(*columns, "place.sequence_id", "place.offset").unionByName(full)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the token ids of each sequence, of bounded length."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
