"""The k-mer sketch in blocks: combined in the tasks, moved as packed arrays.

A block is a range of columns of one (copy, level). A task keeps the cells of
its input in NumPy arrays and sends each block as one row of packed arrays,
instead of one row a cell; blocks of the same range are merged where they
meet. A block whose columns all are invalid (hit by two fingerprints) stays so
whatever is added, so it is sent as a mark without cells, and a task that has
filled a whole (copy, level) stops looking at it. This is found on the way, of
what the task has counted itself, so it needs no second read and no threshold.

Merged blocks are the same for any order and partitioning of the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merscope.functions.bases import word_names
from merscope.functions.hash_arrays import ARRAY_FAMILIES, md5_hash
from merscope.functions.hashing import MAX_LEVEL
from merscope.operators.packing import HELD, Distinct, base_codes, gathered_kmers, least_bytes, spelled
from merscope.operators.segments import check_k, tile_sequences
from merscope.operators.sketch import CELL_COLUMNS, CELL_SCHEMA, MARK, SATURATED, SketchParams

KEY = ["copy", "level", "part"]
BLOCK_SCHEMA = "copy int, level int, part int, full boolean, cols binary, low binary, high binary, cnt binary"
BLOCK_NAMES = [*KEY, "full", "cols", "low", "high", "cnt"]
BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 4]

# Columns of a block, at most; their numbers within it take 16 bits.
PART_EXP = 14
# A task sends what it has when its arrays take this much, or its counts could outgrow 32 bits. At the production
# size all levels that are neither sparse nor full fit in, so that a task fills and closes the low ones.
MOST_BYTES = 288 << 20
MOST_HITS = 1 << 31
# Blocks handed to Spark at a time.
ROWS = 64
# Cells handed to Spark, and k-mers hashed by md5, at a time.
CELLS = 1 << 17


def part_exp(params: SketchParams) -> int:
    return min(PART_EXP, params.r_exp)


def parts(params: SketchParams) -> int:
    return params.columns >> part_exp(params)


@dataclass
class Cells:
    """Cells in order of their columns: smallest and largest fingerprint and hits of each."""

    col: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cnt: np.ndarray


def cells_of_hits(hits: np.ndarray, weights: np.ndarray | None, u_exp: int) -> Cells:
    """Cells from hits, each a number with the column above its ``u_exp`` fingerprint bits."""
    if weights is None:
        hits = np.sort(hits)
    else:
        order = np.argsort(hits)
        hits, weights = hits[order], weights[order]
    col = hits >> np.uint32(u_exp)
    begins = np.flatnonzero(np.append(True, col[1:] != col[:-1]))
    ends = np.append(begins[1:], len(hits))
    fingerprint = np.uint32((1 << u_exp) - 1)
    cnt = ends - begins if weights is None else np.add.reduceat(weights, begins)
    return Cells(col[begins].astype(np.int64), hits[begins] & fingerprint, hits[ends - 1] & fingerprint, cnt)


class Level:
    """Cells of one (copy, level): a list of parts while few, an array of all columns beyond."""

    def __init__(self, columns: int, kind: type = np.uint32, hit_kind: type = np.int64):
        self.columns = columns
        # Of fingerprints and of hits.
        self.kind, self.hit_kind = np.dtype(kind), np.dtype(hit_kind)
        self.few: list[Cells] = []
        self.held = 0
        self.hits = 0
        self.checked = 0
        self.low = self.high = self.cnt = None

    def size(self) -> int:
        if self.low is None:
            return self.held * 24
        return self.columns * (2 * self.kind.itemsize + self.hit_kind.itemsize)

    def add(self, cells: Cells, hits: int) -> None:
        self.hits += hits
        if self.low is None and self.held + len(cells.col) < self.columns // 8:
            self.few.append(cells)
            self.held += len(cells.col)
            return
        if self.low is None:
            self.low = np.full(self.columns, np.iinfo(self.kind).max, self.kind)
            self.high = np.zeros(self.columns, self.kind)
            self.cnt = np.zeros(self.columns, self.hit_kind)
            for early in self.few:
                self.put(early)
            self.few = []
        self.put(cells)

    def put(self, cells: Cells) -> None:
        """Each column is in ``cells`` once."""
        at = cells.col
        self.low[at] = np.minimum(self.low[at], cells.low)
        self.high[at] = np.maximum(self.high[at], cells.high)
        self.cnt[at] = self.cnt[at] + cells.cnt

    def filled(self) -> bool:
        """Whether all columns are invalid; looked at after every few hits a column."""
        if self.low is None or self.hits - self.checked < 4 * self.columns:
            return False
        self.checked = self.hits
        return bool((self.low < self.high).all())

    def cells(self) -> Cells:
        if self.low is None:
            if not self.few:
                none = np.zeros(0, np.int64)
                return Cells(none, none.astype(np.uint32), none.astype(np.uint32), none)
            col, low, high, cnt = (np.concatenate([getattr(c, name) for c in self.few]) for name in ("col", "low", "high", "cnt"))
            order = np.argsort(col, kind="stable")
            col = col[order]
            begins = np.flatnonzero(np.append(True, col[1:] != col[:-1]))
            return Cells(
                col[begins],
                np.minimum.reduceat(low[order], begins),
                np.maximum.reduceat(high[order], begins),
                np.add.reduceat(cnt[order], begins),
            )
        at = np.flatnonzero(self.cnt)
        return Cells(at, self.low[at], self.high[at], self.cnt[at].astype(np.int64))


def fingerprint_type(u_exp: int) -> type:
    return np.uint16 if u_exp <= 16 else np.uint32


def count_bytes(cnt: np.ndarray) -> bytes:
    """Hits in the fewest bytes that hold all of them; the reader tells by the length."""
    return least_bytes(cnt).tobytes()


def block_row(copy: int, level: int, part: int, cells: Cells, size: int, u_exp: int) -> tuple:
    """The row of one block of ``size`` columns; ``cells.col`` counts from its first column."""
    if len(cells.col) == size and (cells.low < cells.high).all():
        return full_row(copy, level, part)
    kind = fingerprint_type(u_exp)
    return (
        copy,
        level,
        part,
        False,
        cells.col.astype(np.uint16).tobytes(),
        cells.low.astype(kind).tobytes(),
        cells.high.astype(kind).tobytes(),
        count_bytes(cells.cnt),
    )


def full_row(copy: int, level: int, part: int) -> tuple:
    return (copy, level, part, True, b"", b"", b"", b"")


def cells_of_row(cols: bytes, low: bytes, high: bytes, cnt: bytes, u_exp: int) -> Cells:
    kind = fingerprint_type(u_exp)
    col = np.frombuffer(cols, np.uint16).astype(np.int64)
    wide = f"u{len(cnt) // len(col)}" if len(col) else np.uint8
    return Cells(col, np.frombuffer(low, kind), np.frombuffer(high, kind), np.frombuffer(cnt, wide).astype(np.int64))


def batch_of(rows: list[tuple], by: tuple[str, ...] = ()) -> pa.RecordBatch:
    """Rows as a batch; the values of the string columns ``by`` stand in front."""
    types = [pa.string()] * len(by) + BLOCK_TYPES
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*by, *BLOCK_NAMES])


def schema_by(by: tuple[str, ...]) -> str:
    return ", ".join([*(f"`{name}` string" for name in by), BLOCK_SCHEMA])


def in_batches(rows: Iterator[tuple], by: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield batch_of(held, by)
            held = []
    if held:
        yield batch_of(held, by)


class TaskSketch:
    """The sketch of what one task has seen since it last sent its blocks."""

    def __init__(self, params: SketchParams, skip: frozenset[tuple[int, int]] = frozenset(), weighted: bool = False):
        self.params = params
        # Between two sendings, only weights can outgrow 32 bits.
        self.kinds = fingerprint_type(params.u_exp), np.int64 if weighted else np.uint32
        self.hash, self.rehash = ARRAY_FAMILIES[params.hash]
        # Left out: known to be full, or found so here and still to be said.
        self.closed = set(skip)
        self.found: list[tuple[int, int]] = []
        self.levels: dict[tuple[int, int], Level] = {}
        self.hits = 0

    def add(self, words: list[np.ndarray], weights: np.ndarray | None = None) -> None:
        self.hits += len(words[0]) if weights is None else int(weights.sum())
        for copy in range(self.params.copies):
            self.add_copy(copy, words, weights)

    def add_copy(self, copy: int, words: list[np.ndarray], weights: np.ndarray | None) -> None:
        h = self.hash(words, copy, self.params.seed)
        level = 0
        while (copy, level) in self.closed and level < MAX_LEVEL:
            level += 1
        if level:
            rest = (h & np.uint64((1 << level) - 1)) == 0
            h, weights = h[rest], None if weights is None else weights[rest]
        self.add_hashed(copy, level, h, self.rehash(h, copy, self.params.seed), weights)

    def add_hashed(self, copy: int, level: int, h: np.ndarray, u: np.ndarray, weights: np.ndarray | None) -> None:
        """Hits of k-mers none of which is on a lower level."""
        bits = self.params.r_exp + self.params.u_exp
        hits = (u & np.uint64((1 << bits) - 1)).astype(np.uint32)
        h = h >> np.uint64(level)
        while len(h):
            here = (h & np.uint64(1)).astype(bool) if level < MAX_LEVEL else np.ones(len(h), bool)
            if (copy, level) not in self.closed and here.any():
                self.store(copy, level, hits[here], None if weights is None else weights[here])
            rest = ~here
            h, hits, weights = h[rest] >> np.uint64(1), hits[rest], None if weights is None else weights[rest]
            level += 1

    def store(self, copy: int, level: int, hits: np.ndarray, weights: np.ndarray | None) -> None:
        own = self.levels.setdefault((copy, level), Level(self.params.columns, *self.kinds))
        own.add(cells_of_hits(hits, weights, self.params.u_exp), len(hits))
        if own.filled():
            del self.levels[copy, level]
            self.closed.add((copy, level))
            self.found.append((copy, level))

    def size(self) -> int:
        return sum(x.size() for x in self.levels.values())

    def should_send(self) -> bool:
        return self.hits >= MOST_HITS or self.size() > MOST_BYTES

    def send(self) -> Iterator[pa.RecordBatch]:
        """All blocks, after which the sketch is empty but for what it leaves out."""
        yield from in_batches(self.rows())
        self.levels, self.found, self.hits = {}, [], 0

    def rows(self) -> Iterator[tuple]:
        shift, u_exp = part_exp(self.params), self.params.u_exp
        for copy, level in self.found:
            for part in range(parts(self.params)):
                yield full_row(copy, level, part)
        for copy, level in sorted(self.levels):
            cells = self.levels[copy, level].cells()
            number = cells.col >> shift
            borders = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number))
            for lo, hi in zip(borders[:-1], borders[1:]):
                part = int(number[lo])
                own = Cells(cells.col[lo:hi] - (part << shift), cells.low[lo:hi], cells.high[lo:hi], cells.cnt[lo:hi])
                yield block_row(copy, level, part, own, 1 << shift, u_exp)


class TaskCells(TaskSketch):
    """The same by the md5 hash, of distinct k-mers spelled out once for all copies; all cells are kept and sent as rows."""

    def __init__(self, params: SketchParams, k: int, skip: frozenset[tuple[int, int]] = frozenset()):
        self.params, self.k, self.skip = params, k, skip
        self.kinds = fingerprint_type(params.u_exp), np.int64
        self.closed, self.found, self.levels, self.hits = skip, [], {}, 0

    def add(self, words: list[np.ndarray], weights: np.ndarray) -> None:
        texts = spelled(words, self.k)
        self.hits += int(weights.sum())
        for copy in range(self.params.copies):
            h, u = md5_hash(texts, copy, self.params.seed)
            self.add_hashed(copy, 0, h, u, weights)

    def store(self, copy: int, level: int, hits: np.ndarray, weights: np.ndarray) -> None:
        own = self.levels.setdefault((copy, level), Level(self.params.columns, *self.kinds))
        own.add(cells_of_hits(hits, weights, self.params.u_exp), len(hits))

    def send(self) -> Iterator[pa.RecordBatch]:
        for copy, level in sorted(self.levels):
            cells = self.levels[copy, level].cells()
            for at in range(0, len(cells.col), CELLS):
                own = [x[at : at + CELLS].astype(np.int64) for x in (cells.col, cells.low, cells.high, cells.cnt)]
                where = [pa.array(np.full(len(own[0]), x, np.int32)) for x in (copy, level)]
                yield pa.RecordBatch.from_arrays([*where, *map(pa.array, own)], CELL_COLUMNS)
        self.levels, self.hits = {}, 0


def md5_cells_of_reads(reads: DataFrame, k: int, params: SketchParams, seq: str = "seq", full=()) -> DataFrame:
    """Unmerged cells, a row each, of the canonical k-mers of ``reads`` by the md5 hash: a narrow step, one read.

    A task hashes each distinct k-mer of some millions once and sends a row for
    each cell these have hit, not for each occurrence and copy.
    """
    table, skip = base_codes(), frozenset(full)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = TaskCells(params, k, skip), Distinct(HELD)

        def hashed() -> None:
            _, words, counts = found.take()
            for at in range(0, len(counts), CELLS):
                own.add([w[at : at + CELLS] for w in words], counts[at : at + CELLS])

        for batch in batches:
            for words in gathered_kmers(batch.column(0), k, table) if batch.num_rows else ():
                if found.add(words):
                    hashed()
                    if own.should_send():
                        yield from own.send()
        if found.rows:
            hashed()
        yield from own.send()

    tiles = tile_sequences(reads, check_k(k), seq).select(F.concat("tile", F.lit(b"\n")).alias("tile"))
    return tiles.mapInArrow(sketch, CELL_SCHEMA)


def check_family(params: SketchParams) -> None:
    if params.hash not in ARRAY_FAMILIES:
        raise ValueError(f"blocks need one of the hashes {sorted(ARRAY_FAMILIES)}")


def blocks_of_reads(reads: DataFrame, k: int, params: SketchParams, seq: str = "seq", full=()) -> DataFrame:
    """Unmerged blocks of the canonical k-mers of ``reads``: a narrow step, one read.

    The pairs ``(copy, level)`` in ``full`` are known to be full and left out.
    """
    check_k(k)
    check_family(params)
    table, skip = base_codes(), frozenset(full)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskSketch(params, skip)
        for batch in batches:
            if batch.num_rows:
                for words in gathered_kmers(batch.column(0), k, table):
                    own.add(words)
                    if own.should_send():
                        yield from own.send()
        yield from own.send()

    tiles = tile_sequences(reads, k, seq).select(F.concat("tile", F.lit(b"\n")).alias("tile"))
    return tiles.mapInArrow(sketch, BLOCK_SCHEMA)


def blocks_of_counts(counts: DataFrame, k: int, params: SketchParams, weight: str = "cnt", full=()) -> DataFrame:
    """Unmerged blocks of distinct packed k-mers with their counts in ``weight``."""
    check_family(params)
    skip, names = frozenset(full), word_names(check_k(k))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskSketch(params, skip, weighted=True)
        for batch in batches:
            if batch.num_rows:
                *words, weights = (c.to_numpy() for c in batch.columns)
                own.add(words, weights)
                if own.should_send():
                    yield from own.send()
        yield from own.send()

    return counts.select(*names, F.col(weight).cast("bigint")).mapInArrow(sketch, BLOCK_SCHEMA)


def marked_blocks(spark: SparkSession, full, params: SketchParams) -> DataFrame:
    """Full blocks of the pairs ``(copy, level)``, of which there are at most copies * (MAX_LEVEL + 1)."""
    pairs = spark.createDataFrame(list(full), "copy int, level int")
    none = [F.lit(b"").alias(name) for name in BLOCK_NAMES[4:]]
    numbered = pairs.select("copy", "level", F.explode(F.sequence(F.lit(0), F.lit(parts(params) - 1))).alias("part"))
    return numbered.select(*KEY, F.lit(True).alias("full"), *none)


class Block:
    """Blocks of one key, merged as they come."""

    def __init__(self, size: int, u_exp: int):
        self.size, self.u_exp = size, u_exp
        self.full = False
        self.level = Level(size)

    def merge(self, full: bool, cols: bytes, low: bytes, high: bytes, cnt: bytes) -> None:
        if full:
            self.full = True
        elif not self.full:
            self.level.add(cells_of_row(cols, low, high, cnt, self.u_exp), 0)

    def row(self, copy: int, level: int, part: int) -> tuple:
        if self.full:
            return full_row(copy, level, part)
        return block_row(copy, level, part, self.level.cells(), self.size, self.u_exp)


def merge_blocks(blocks: DataFrame, params: SketchParams, by: tuple[str, ...] = ()) -> DataFrame:
    """One block a key, for each value of the string columns ``by``.

    Rows of a key come in order and are merged one by one, so that a task
    holds one block, however many tasks have sent it.
    """
    size, u_exp, width = 1 << part_exp(params), params.u_exp, len(by) + len(KEY)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, block = None, None
        for batch in batches:
            for found, *arrays in zip(zip(*(c.to_pylist() for c in batch.columns[:width])), *batch.columns[width:]):
                if found != key:
                    if block is not None:
                        yield (*key[: len(by)], *block.row(*key[len(by) :]))
                    key, block = found, Block(size, u_exp)
                block.merge(*(x.as_py() for x in arrays))
        if block is not None:
            yield (*key[: len(by)], *block.row(*key[len(by) :]))

    ordered = blocks.select(*by, *BLOCK_NAMES).repartition(*by, *KEY).sortWithinPartitions(*by, *KEY)
    return ordered.mapInArrow(lambda batches: in_batches(merged(batches), by), schema_by(by))


def full_pairs(blocks: DataFrame, params: SketchParams) -> list[tuple[int, int]]:
    """The pairs ``(copy, level)`` of merged blocks that are full altogether."""
    found = blocks.where("full").groupBy("copy", "level").agg(F.count(F.lit(1)).alias("many"))
    return sorted((r["copy"], r["level"]) for r in found.where(F.col("many") == parts(params)).collect())


def block_level_histogram(blocks: DataFrame, params: SketchParams, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`merscope.operators.estimate.level_histogram`, from merged blocks, for each value of ``by``."""
    size, u_exp, columns = 1 << part_exp(params), params.u_exp, params.columns
    names = [*by, "copy", "level", "v", "t"]
    types = [pa.string()] * len(by) + [pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, full, arrays = row[: len(by) + 2], row[len(by) + 3], row[len(by) + 4 :]
                if full:
                    found.append((*key, 0, size))
                    continue
                cells = cells_of_row(*arrays, u_exp)
                found.append((*key, 0, len(cells.col)))
                valid = (cells.low == cells.high) & (cells.cnt < SATURATED) & (cells.cnt <= n)
                times = np.bincount(cells.cnt[valid])
                found += [(*key, v, int(times[v])) for v in np.flatnonzero(times).tolist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    schema = ", ".join([*(f"`{name}` string" for name in by), "copy int, level int, v bigint, t bigint"])
    counted = blocks.select(*by, *BLOCK_NAMES).mapInArrow(count, schema).groupBy(*by, "copy", "level", "v").agg(F.sum("t").alias("t"))
    occupied = F.when(F.col("v") == 0, columns - F.col("t")).otherwise(F.col("t"))
    return counted.select(*by, "copy", "level", "v", occupied.cast("bigint").alias("t"))


def cells_of_blocks(blocks: DataFrame, params: SketchParams) -> DataFrame:
    """Merged blocks as one row a cell, for what works on rows: see ``operators.sketch``.

    The columns of a full block, of which only that is known, become invalid
    cells without hits; a level that is full altogether becomes its mark.
    """
    shift, u_exp = part_exp(params), params.u_exp
    names = ["copy", "level", "col", "pos_min", "pos_max", "cnt"]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for copy, level, part, full, *arrays in zip(*(c.to_pylist() for c in batch.columns)):
                if full:
                    size = 1 << shift
                    cells = Cells(np.arange(size), np.zeros(size, np.int64), np.ones(size, np.int64), np.zeros(size, np.int64))
                else:
                    cells = cells_of_row(*arrays, u_exp)
                size = len(cells.col)
                columns = [
                    pa.array(np.full(size, copy, np.int32)),
                    pa.array(np.full(size, level, np.int32)),
                    pa.array(cells.col + (part << shift)),
                    *(pa.array(x.astype(np.int64)) for x in (cells.low, cells.high, cells.cnt)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    full = full_pairs(blocks, params)
    if not full:
        return blocks.mapInArrow(spell, CELL_SCHEMA)
    spark = blocks.sparkSession
    marked = spark.createDataFrame([(c, level, MARK, 0, 1, 0) for c, level in full], CELL_SCHEMA)
    rest = blocks.join(F.broadcast(marked.select("copy", "level")), ["copy", "level"], "left_anti").select(*BLOCK_NAMES)
    return rest.mapInArrow(spell, CELL_SCHEMA).unionByName(marked)
