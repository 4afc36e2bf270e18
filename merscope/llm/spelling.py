"""Spelling variants: k-d trees over letter counts find the words one edit apart.

A word is a point whose coordinates count its letters. Replacing a letter
takes one from a coordinate and gives one to another, so that the point moves
by two in L1 distance; inserting or deleting one moves it by one, to the words
of the next length. The words one edit from a word are therefore in the small
box around its point, in the tree of its own length or of the next, and a tree
prunes all branches the box does not reach. Letter order is compared for the
points found.

The upper part of the trees is grown on a bounded sample and cuts space into
cells, each a small row group in one task; it decides balance, not results.
Words are sent to their own cell as points and to the others their box reaches
as queries. A task grows the rest of the tree over the points of a cell, which
is all it holds, and lets the queries of the cell pass by in batches.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merscope.functions.arrow import text_and_offsets
from merscope.llm.batches import small_batches
from merscope.llm.scratch import saved

LEAST_LETTERS = 7
LEAST_COUNT = 2
DAMAGED = 31
# A form is taken on if it is this many times as frequent.
TIMES = 10
# Coordinates; letters beyond a-z share them, which keeps the distances bounds.
DIMENSIONS = 32
# Words the upper trees are grown on, points in a cell by the sample, and in a leaf of the lower tree.
SAMPLE = 50_000
CELL = 2048
LEAF = 16
# Bytes of a text worked on at once, distinct words kept back for adding up, and cells of a comparison.
STRETCH = 1 << 20
HELD = 100_000
COMPARED = 1 << 22

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# U+00C0 to U+00FF are this byte and one more in UTF-8, and no other letters begin with it.
LEAD = 0xC3
AXIS = np.arange(256) % DIMENSIONS
AXIS[97:123] = np.arange(26)


def inside_runs(raw: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to letters of the runs."""
    inside = LETTER[raw] | (raw == LEAD)
    inside[1:] |= raw[:-1] == LEAD
    return inside


def stretches(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A text in pieces of about ``STRETCH`` bytes that cut no run."""
    at = 0
    while at < len(raw):
        end = at + STRETCH
        while end < len(raw):
            gaps = np.flatnonzero(~inside_runs(raw[at:end])[:-1])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end += STRETCH
        yield raw[at:end]
        at = min(end, len(raw))


def runs(raw: np.ndarray) -> list[bytes]:
    """The runs of at least ``LEAST_LETTERS`` letters, A-Z lowered, as UTF-8."""
    bounds = np.flatnonzero(np.diff(np.concatenate(([0], inside_runs(raw).view(np.int8), [0]))))
    starts, ends = bounds[::2], bounds[1::2]
    leads = np.concatenate(([0], np.cumsum(raw == LEAD)))
    long = ends - starts - (leads[ends] - leads[starts]) >= LEAST_LETTERS
    text = LOWER[raw].tobytes()
    return [text[s:e] for s, e in zip(starts[long].tolist(), ends[long].tolist())]


def damaged(run: bytes, prefix_crc: int) -> bytes | None:
    """The word a run counts as: some lose a letter; None if it is then too short."""
    h = zlib.crc32(run, prefix_crc)
    if h % DAMAGED:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode() if len(letters) > LEAST_LETTERS else None


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of the words with at least ``LEAST_COUNT`` occurrences; those of a task are added up first."""

    def batch_of(counts: Counter) -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            raw, borders = text_and_offsets(batch.column(1))
            for row, name in enumerate(batch.column(0).to_pylist()):
                prefix = zlib.crc32(f"{name}:".encode() if name is not None else b":")
                for piece in stretches(raw[borders[row] : borders[row + 1]]):
                    for run, times in Counter(runs(piece)).items():
                        word = damaged(run, prefix)
                        if word is not None:
                            counts[word] += times
                    if len(counts) >= HELD:
                        yield batch_of(counts)
                        counts.clear()
        if counts:
            yield batch_of(counts)

    texts = docs.select(F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_counts(words: np.ndarray) -> np.ndarray:
    """Points of words of one length, given as a matrix of Latin-1 codes; counts stop at 255."""
    axes = AXIS[words] + np.arange(len(words))[:, None] * DIMENSIONS
    return np.minimum(np.bincount(axes.ravel(), minlength=len(words) * DIMENSIONS), 255).astype(np.uint8).reshape(-1, DIMENSIONS)


@dataclass
class Tree:
    """Splits ``(axis, most, low, high)``: points of at most ``most`` on the axis
    are below ``low``. A child below 0 is the leaf ``-1 - child``."""

    splits: list[tuple[int, int, int, int]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)


def best_split(points: np.ndarray) -> tuple[int, int] | None:
    """The axis and value that come closest to halving the points, or None if all are equal."""
    middle = np.partition(points, len(points) // 2, axis=0)[len(points) // 2]
    shares = np.stack([(points < middle).mean(axis=0), (points <= middle).mean(axis=0)])
    shares[(shares == 0) | (shares == 1)] = np.inf
    which, axis = np.unravel_index(np.argmin(np.abs(shares - 0.5)), shares.shape)
    if not np.isfinite(shares[which, axis]):
        return None
    return int(axis), int(middle[axis]) - (1 - int(which))


def grow(points: np.ndarray, most: float) -> Tree:
    """A k-d tree whose leaves hold at most ``most`` points, but for equal ones."""
    tree, todo = Tree(), [(np.arange(len(points)), None, 0)]
    while todo:
        rows, parent, side = todo.pop()
        split = best_split(points[rows]) if len(rows) > most else None
        if split is None:
            tree.leaves.append(rows)
            here = -len(tree.leaves)
        else:
            here = len(tree.splits)
            tree.splits.append((*split, 0, 0))
            low = points[rows, split[0]] <= split[1]
            todo += [(rows[low], here, 2), (rows[~low], here, 3)]
        if parent is not None:
            changed = list(tree.splits[parent])
            changed[side] = here
            tree.splits[parent] = tuple(changed)
    return tree


def reached(tree: Tree, points: np.ndarray, more: bool, less: bool) -> Iterator[tuple[int, np.ndarray]]:
    """``(leaf, rows)``: the points whose box reaches the leaf.

    The box holds what has at most one more on one axis, if ``more``, and at
    most one less on one axis, if ``less``. A branch beyond the split is
    entered by using one of these up, so each leaf is reached at most once.
    """
    every = np.arange(len(points))
    todo = [(0 if tree.splits else -1, every, np.full(len(points), more), np.full(len(points), less))]
    while todo:
        node, rows, gain, lose = todo.pop()
        if len(rows) == 0:
            continue
        if node < 0:
            yield -1 - node, rows
            continue
        axis, most, low, high = tree.splits[node]
        at = points[rows, axis].astype(np.int16)
        below = at <= most
        down = ~below & lose & (at == most + 1)
        up = below & gain & (at == most)
        for child, side, g, l in ((low, below | down, gain, lose & ~down), (high, ~below | up, gain & ~up, lose)):
            todo.append((child, rows[side], g[side], l[side]))


def one_letter_more(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether each long word is the short one with a letter put in."""
    size = short.shape[1]
    front, back = short == long[:, :-1], (short == long[:, 1:])[:, ::-1]
    same = [np.where(x.all(axis=1), size, x.argmin(axis=1)) for x in (front, back)]
    return same[0] + same[1] >= size


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Words of ``size`` letters as a matrix of their Latin-1 codes."""
    raw, _ = text_and_offsets(column)
    return raw.reshape(-1, size)


class Near:
    """How many near words each of some words has, and the most frequent of them so far."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.count = np.zeros(len(words), np.int64)
        self.n = np.zeros(len(words), np.int64)
        self.best = np.zeros(len(words), "S1")

    def add(self, rows: np.ndarray, others: np.ndarray, n: np.ndarray) -> None:
        """``others``, as a matrix of letters with their frequencies ``n``, are near the words of ``rows``."""
        if len(rows) == 0:
            return
        self.count += np.bincount(rows, minlength=len(self.count))
        names = np.ascontiguousarray(others).view(f"S{others.shape[1]}").ravel()
        order = np.lexsort((names, -n, rows))
        first = order[np.append(True, np.diff(rows[order]) != 0)]
        at, n, names = rows[first], n[first], names[first]
        better = (n > self.n[at]) | ((n == self.n[at]) & (names < self.best[at]))
        self.best = self.best.astype(np.promote_types(self.best.dtype, names.dtype), copy=False)
        self.n[at[better]], self.best[at[better]] = n[better], names[better]

    def batch(self) -> pa.RecordBatch:
        found = np.flatnonzero(self.count)
        words = np.ascontiguousarray(self.words[found]).view(f"S{self.words.shape[1]}").ravel()
        columns = [pa.array(x.tolist(), pa.binary()) for x in (words, self.best[found])]
        counts = [pa.array(x[found]) for x in (self.count, self.n)]
        return pa.RecordBatch.from_arrays([columns[0], counts[0], counts[1], columns[1]], ["word", "near", "near_n", "best"])


class Cell:
    """The points of one cell, and the rest of the tree over them."""

    def __init__(self, words: np.ndarray, n: np.ndarray):
        self.words, self.n = words, n
        self.points = letter_counts(words)
        self.tree = grow(self.points, LEAF)
        self.near = Near(words)

    def search(self, words: np.ndarray, n: np.ndarray, near: Near, own: bool) -> None:
        """Note near words of the cell for ``words`` and the other way round.

        ``words`` are the cell's own, words of the same length of another
        cell, or words of a letter less.
        """
        shorter = words.shape[1] < self.words.shape[1]
        points = letter_counts(words)
        pairs = []
        for leaf, rows in reached(self.tree, points, True, not shorter):
            mates = self.tree.leaves[leaf]
            step = max(1, COMPARED // (len(mates) * DIMENSIONS))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                gap = np.abs(points[part][:, None].astype(np.int16) - self.points[mates][None]).sum(axis=2)
                q, p = np.nonzero(gap <= (1 if shorter else 2))
                q, p = part[q], mates[p]
                if own:
                    q, p = q[q < p], p[q < p]
                a, b = words[q], self.words[p]
                true = one_letter_more(a, b) if shorter else (a != b).sum(axis=1) == 1
                pairs.append((q[true], p[true]))
        if pairs:
            q, p = (np.concatenate(x) for x in zip(*pairs))
            near.add(q, self.words[p], self.n[p])
            self.near.add(p, words[q], n[q])


def upper_trees(vocabulary: DataFrame) -> dict[int, Tree]:
    """For each length in a sample of about ``SAMPLE`` words, the splits that cut its words into cells.

    The sample are the words of low hash: a share of all, found in one scan.
    Only their letter counts come to the driver. A length that is not in it
    is one cell.
    """
    total = vocabulary.count()
    share = min(1.0, SAMPLE / max(total, 1))
    low = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows in by_length(batch.column(0)):
                points = letter_counts(matrix(batch.column(0).take(pa.array(rows)), size))
                packed = pa.array([p.tobytes() for p in points], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), size, np.int64)), packed], ["size", "point"])

    found: dict[int, list[bytes]] = {}
    for size, point in vocabulary.where(low).select("code").mapInArrow(measure, "size bigint, point binary").collect():
        found.setdefault(size, []).append(bytes(point))
    trees = {}
    for size, points in sorted(found.items()):
        trees[size] = grow(np.frombuffer(b"".join(points), np.uint8).reshape(-1, DIMENSIONS), max(8.0, CELL * share))
        trees[size].leaves = [np.zeros(0, np.int64)] * len(trees[size].leaves)
    return trees


def by_length(column: pa.Array) -> list[tuple[int, np.ndarray]]:
    """``(length, rows)`` of a column of words."""
    _, borders = text_and_offsets(column)
    sizes = np.diff(borders)
    return [(int(size), np.flatnonzero(sizes == size)) for size in np.unique(sizes)]


POINT, QUERY = 0, 1
CELL_SCHEMA = "size bigint, cell bigint, kind int, code binary, n bigint"


def sent_to_cells(vocabulary: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Words by the cell they are points of and the cells they search, ``size`` being the length of a cell's points.

    Two cells of one length meet once: the words of the lower one search the other.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows in by_length(batch.column(0)):
                points = letter_counts(matrix(batch.column(0).take(pa.array(rows)), size))
                tree, longer = trees.get(size, Tree()), trees.get(size + 1, Tree())
                home = np.zeros(len(rows), np.int64)
                for leaf, at in reached(tree, points, False, False):
                    home[at] = leaf
                out = [(size, home, rows, POINT)]
                for leaf, at in reached(tree, points, True, True):
                    at = at[home[at] < leaf]
                    out.append((size, np.full(len(at), leaf), rows[at], QUERY))
                for leaf, at in reached(longer, points, True, False):
                    out.append((size + 1, np.full(len(at), leaf), rows[at], QUERY))
                for length, cells, at, kind in out:
                    if len(at):
                        taken = pa.array(at)
                        columns = [
                            pa.array(np.full(len(at), length, np.int64)),
                            pa.array(cells.astype(np.int64)),
                            pa.array(np.full(len(at), kind, np.int32)),
                            batch.column(0).take(taken),
                            batch.column(1).take(taken),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["size", "cell", "kind", "code", "n"])

    return vocabulary.select("code", "n").mapInArrow(send, CELL_SCHEMA)


def search_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words found in rows that come by cell, its points before its queries."""
    at, cell, points = None, None, []

    def opened() -> Cell:
        size = at[0]
        made = Cell(np.concatenate([matrix(c, size) for c, _ in points]), np.concatenate([n for _, n in points]))
        made.search(made.words, made.n, made.near, own=True)
        return made

    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        lengths = np.diff(text_and_offsets(batch.column(3))[1])
        marks = np.column_stack([keys, lengths])
        borders = np.flatnonzero(np.append(True, (np.diff(marks, axis=0) != 0).any(axis=1)))
        for lo, hi in zip(borders, np.append(borders[1:], len(keys))):
            here = (int(keys[lo, 0]), int(keys[lo, 1]))
            codes, n = batch.column(3).slice(lo, hi - lo), batch.column(4).slice(lo, hi - lo).to_numpy()
            if here != at:
                if points and cell is None:
                    cell = opened()
                if cell is not None:
                    yield cell.near.batch()
                at, cell, points = here, None, []
            if keys[lo, 2] == POINT:
                points.append((codes, n))
            elif points:
                cell = opened() if cell is None else cell
                words = matrix(codes, int(lengths[lo]))
                near = Near(words)
                cell.search(words, n, near, own=False)
                yield near.batch()
    if points:
        yield (opened() if cell is None else cell).near.batch()


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``(word, n_near, near_n, near)`` of the words with a near word: how many, and the most frequent one."""
    rows = sent_to_cells(vocabulary, upper_trees(vocabulary))
    ordered = rows.repartition("size", "cell").sortWithinPartitions("size", "cell", "kind", F.length("code"))
    found = ordered.mapInArrow(search_cells, "word binary, near bigint, near_n bigint, best binary")
    latin = "ISO-8859-1"
    spelt = found.select(F.decode("word", latin).alias("word"), "near", (-F.col("near_n")).alias("less"), F.decode("best", latin).alias("best"))
    most = spelt.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "best")).alias("top"))
    return most.select("word", "n_near", (-F.col("top.less")).alias("near_n"), F.col("top.best").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words with a form: the last of the chain, whose length each step doubles.

    A form is ``TIMES`` times as frequent as its word, so that a chain is
    short and has no circle.
    """
    now = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        now = saved(joined)
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word of ``docs``: ``word, form, root, n, n_near, form_n``.

    Null and empty texts have no words; a null id counts as an empty one in
    the draw of the letter that some runs lose. Each row counts, repeated ones
    too. Near words of equal frequency are ranked by code points. An empty
    table gives no rows. Other columns are not read.
    """
    with small_batches(docs.sparkSession):
        code = F.encode("word", "ISO-8859-1").alias("code")
        vocabulary = saved(word_counts(docs).select("word", "n", code))
        found = vocabulary.select("word", "n").join(near_words(vocabulary), "word", "left")
        follows = F.col("near_n") >= TIMES * F.col("n")
        named = saved(
            found.select(
                "word",
                "n",
                F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                F.when(follows, F.col("near")).alias("form"),
                F.when(follows, F.col("near_n")).alias("form_n"),
            )
        )
        last = roots(named.where(F.col("form").isNotNull()))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
