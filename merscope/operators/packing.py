"""Arrow kernel: bytes of sequence in, packed canonical k-mers out.

Spark has no rolling-window expression over a string, so this one step runs as
``mapInArrow``. Per batch it is a fixed number of NumPy passes over the bytes;
nothing is done per row and memory is bounded by ``STEP`` and ``ROWS``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa

from merscope.functions.arrow import text_and_offsets
from merscope.functions.bases import BASES, word_names, word_spans

# Windows worked on at a time, so that the arrays stay in the CPU's cache, and
# k-mers handed back to Spark at a time.
STEP = 1 << 14
ROWS = 1 << 17
NOT_A_BASE = 4
# Windows of runs that are counted together.
RUN_WINDOWS = 1 << 19
# K-mers a task gathers before it reduces them to distinct ones, and bins that these are dealt out by.
HELD = 1 << 22
BIN_BITS = 12
# K-mers of bins that are merged together.
MERGED = 1 << 16


def base_codes() -> np.ndarray:
    """Byte -> 0..3 for bases of either case, 4 for anything else."""
    table = np.full(256, NOT_A_BASE, np.uint8)
    for code, base in enumerate(BASES):
        table[ord(base)] = table[ord(base.lower())] = code
    return table


def joined(left: tuple, right: tuple) -> tuple:
    """Windows of m+n bases from those of m and of n: ``(length, forward,
    reverse complement)``, in the smallest integers that hold them."""
    m, f, r = left
    n, g, s = right
    size = max(len(g) - m, 0)
    kind = np.min_scalar_type((1 << 2 * (m + n)) - 1)
    fwd = (f[:size].astype(kind) << 2 * n) | g[m : m + size]
    rev = (s[m : m + size].astype(kind) << 2 * m) | r[:size]
    return m + n, fwd, rev


def packed_windows(codes: np.ndarray, lengths: set[int]) -> dict[int, tuple]:
    """For each length n: the packed n-base window at every position, forward
    and reverse-complemented.

    Windows of 1, 2, 4, ... bases are joined pairwise and any other length is
    put together from those, so the work per base grows with log n.
    """
    powers = [(1, codes, 3 - codes)]
    while 2 * powers[-1][0] <= max(lengths):
        powers.append(joined(powers[-1], powers[-1]))
    found = {}
    for n in lengths:
        _, fwd, rev = reduce(joined, [p for p in powers if p[0] & n])
        found[n] = (fwd.astype(np.int64), rev.astype(np.int64))
    return found


def canonical_words(codes: np.ndarray, k: int) -> list[np.ndarray]:
    """Words of the canonical k-mer starting at every position of ``codes``.

    Word 0 holds the leading bases, so comparing words in order compares the
    k-mers. Positions whose window holds a non-base carry meaningless values.
    """
    count = len(codes) - k + 1
    spans = word_spans(k)
    windows = packed_windows(codes & 3, {stop - start for start, stop in spans})
    fwd = [windows[b - a][0][a : a + count] for a, b in spans]
    rev = [windows[b - a][1][k - b : k - b + count] for a, b in spans]
    if len(spans) == 1:
        return [np.minimum(fwd[0], rev[0])]
    smaller = np.zeros(count, bool)
    tied = np.ones(count, bool)
    for f, r in zip(fwd, rev):
        smaller |= tied & (f < r)
        tied &= f == r
    return [np.where(smaller, f, r) for f, r in zip(fwd, rev)]


def spelled(words: list[np.ndarray], k: int) -> np.ndarray:
    """The letters of packed k-mers, a row of bytes each."""
    letters = np.frombuffer(BASES.encode(), np.uint8)
    texts = np.empty((len(words[0]), k), np.uint8)
    for word, (start, stop) in zip(words, word_spans(k)):
        for at in range(start, stop):
            texts[:, at] = letters[(word >> (2 * (stop - 1 - at))) & 3]
    return texts


def whole_kmers(text: np.ndarray, k: int, table: np.ndarray):
    """Words of the canonical k-mers in ``text``, a number of windows at a time."""
    for at in range(0, len(text) - k + 1, STEP):
        codes = table[text[at : at + STEP + k - 1]]
        breaks = np.zeros(len(codes) + 1, np.int32)
        np.cumsum(codes == NOT_A_BASE, out=breaks[1:])
        whole = np.flatnonzero(breaks[k:] == breaks[:-k])
        yield [w[whole] for w in canonical_words(codes, k)]


def gathered_kmers(column: pa.Array, k: int, table: np.ndarray):
    """The same, about ``ROWS`` at a time, for a column whose rows each end in
    a byte that is not a base, so that no window spans two rows."""
    text, _ = text_and_offsets(column)
    done, rows = [], 0
    for words in whole_kmers(text, k, table):
        done.append(words)
        rows += len(words[0])
        if rows >= ROWS:
            yield [np.concatenate(w) for w in zip(*done)]
            done, rows = [], 0
    if rows:
        yield [np.concatenate(w) for w in zip(*done)]


def kmer_batches(k: int):
    """``mapInArrow`` function from a binary column as in :func:`gathered_kmers` to packed k-mers."""
    names = word_names(k)
    table = base_codes()

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                for words in gathered_kmers(batch.column(0), k, table):
                    yield pa.RecordBatch.from_arrays([pa.array(w) for w in words], names)

    return pack


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, by windows of 1, 2, 4, ... values."""
    done = 1
    while 2 * done <= width:
        values, done = np.minimum(values[:-done], values[done:]), 2 * done
    rest = width - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def minimizer_runs(text: np.ndarray, k: int, m: int, table: np.ndarray):
    """``(first, last, bin)`` of the runs of consecutive windows of ``text`` that share their smallest m-mer by a hash.

    M-mers are canonical, so a k-mer and its reverse complement have the same bin.
    """
    for at in range(0, len(text) - k + 1, STEP):
        codes = table[text[at : at + STEP + k - 1]]
        breaks = np.zeros(len(codes) + 1, np.int32)
        np.cumsum(codes == NOT_A_BASE, out=breaks[1:])
        whole = np.flatnonzero(breaks[k:] == breaks[:-k])
        if len(whole):
            mixed = canonical_words(codes, m)[0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            bins = (least_of(mixed, k - m + 1)[whole] >> np.uint64(33)).astype(np.int32)
            begins = np.flatnonzero(np.append(True, (np.diff(whole) != 1) | (np.diff(bins) != 0)))
            ends = np.append(begins[1:], len(whole)) - 1
            yield whole[begins] + at, whole[ends] + at, bins[begins]


def run_batches(k: int, m: int):
    """``mapInArrow`` function from such a column to ``(bin, run)``: all windows of a run have their k-mers in that bin."""
    table = base_codes()

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            text, _ = text_and_offsets(batch.column(0))
            raw = text.tobytes()
            for first, last, bins in minimizer_runs(text, k, m, table):
                runs = [raw[a : b + k] + b"\n" for a, b in zip(first.tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(runs, pa.binary())], ["bin", "run"])

    return cut


def distinct_rows(words: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of several columns, in order, and how often each is there."""
    order = np.lexsort(words[::-1])
    words = [w[order] for w in words]
    changed = np.zeros(max(0, len(order) - 1), bool)
    for w in words:
        changed |= w[1:] != w[:-1]
    begins = np.flatnonzero(np.append(True, changed))[: len(order)]
    return [w[begins] for w in words], np.diff(np.append(begins, len(order)))


def mixed(words: list[np.ndarray]) -> np.ndarray:
    """A number for each row whose leading bits depend on all words; of one word it is a bijection."""
    return sum((w.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * i) for i, w in enumerate(words)), np.uint64(0))


def counted_rows(words: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """``(mixed, words, counts)`` of the distinct rows of several columns, in order of their mixed numbers.

    Rows are sorted by that one number. Only if different rows share one are
    they sorted by all of their words too.
    """
    key = mixed(words)
    order = np.argsort(key)
    key, rows = key[order], [w[order] for w in words]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    other = np.append(True, np.any([w[1:] != w[:-1] for w in rows], axis=0))[: len(key)]
    if not np.array_equal(new, other):
        order = np.lexsort([*words[::-1], mixed(words)])
        key, rows = mixed(words)[order], [w[order] for w in words]
        other = np.append(True, np.any([w[1:] != w[:-1] for w in rows], axis=0))
    begins = np.flatnonzero(other)
    if weights is None or not len(begins):
        counts = np.diff(np.append(begins, len(key)))
    else:
        counts = np.add.reduceat(weights[order], begins)
    return key[begins], [w[begins] for w in rows], counts


class Distinct:
    """Distinct k-mers and their counts, reduced whenever as many have come as there are already."""

    def __init__(self, most: int):
        self.most = most
        self.fresh: list[list[np.ndarray]] = []
        self.counts: list[np.ndarray | None] = []
        self.rows = self.reduced = 0

    def add(self, words: list[np.ndarray], counts: np.ndarray | None = None) -> bool:
        """Whether the distinct ones are more than half of ``most``."""
        self.fresh.append(words)
        self.counts.append(counts)
        self.rows += len(words[0])
        if self.rows >= max(self.most, 2 * self.reduced):
            _, words, counts = self.take()
            self.fresh, self.counts = [words], [counts]
            self.rows = self.reduced = len(counts)
        return self.reduced > self.most // 2

    def take(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """:func:`counted_rows` of all, after which none are held."""
        words = [np.concatenate(w) for w in zip(*self.fresh)]
        weights = None
        if any(c is not None for c in self.counts):
            weights = np.concatenate([np.ones(len(w[0]), np.int64) if c is None else c for w, c in zip(self.fresh, self.counts)])
        self.fresh, self.counts, self.rows, self.reduced = [], [], 0, 0
        return counted_rows(words, weights)


def least_bytes(counts: np.ndarray) -> np.ndarray:
    """Counts in the smallest integers that hold them; a reader tells by the length."""
    return counts.astype(np.min_scalar_type(int(counts.max())) if len(counts) else np.uint8)


def bin_batches(k: int):
    """``mapInArrow`` function from such a column to ``(bin, kmers, cnt)``: distinct k-mers as packed arrays, a row a bin."""
    table = base_codes()

    def rows(found: Distinct):
        key, words, counts = found.take()
        bins = (key >> np.uint64(64 - BIN_BITS)).astype(np.int32)
        begins = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
        spans = list(zip(begins.tolist(), [*begins[1:].tolist(), len(bins)]))
        kmers = [b"".join([w[a:b].tobytes() for w in words]) for a, b in spans]
        cnt = [least_bytes(counts[a:b]).tobytes() for a, b in spans]
        columns = [pa.array(bins[begins]), pa.array(kmers, pa.binary()), pa.array(cnt, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["bin", "kmers", "cnt"])

    def cut(batches):
        found = Distinct(HELD)
        for batch in batches:
            for words in gathered_kmers(batch.column(0), k, table) if batch.num_rows else ():
                if found.add(words):
                    yield from rows(found)
        if found.rows:
            yield from rows(found)

    return cut


def merge_bins(k: int):
    """``mapInArrow`` function from ``(bin, kmers, cnt)`` in order of the bins to distinct packed k-mers and their counts.

    No k-mer is in two bins. Small bins are merged together; of a large one
    the distinct k-mers are held, however many tasks have sent them.
    """
    names = [*word_names(k), "cnt"]

    def counted(found: Distinct):
        _, words, cnt = found.take()
        for at in range(0, len(cnt), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + ROWS]) for c in (*words, cnt)], names)

    def merge(batches):
        found, last = Distinct(16 * MERGED), None
        for batch in batches:
            for number, kmers, cnt in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if number != last and found.rows >= MERGED:
                    yield from counted(found)
                words = np.frombuffer(kmers.as_buffer(), np.int64).reshape(len(names) - 1, -1)
                counts = np.frombuffer(cnt.as_buffer(), f"u{len(cnt.as_buffer()) // words.shape[1]}")
                found.add([w.copy() for w in words], counts.astype(np.int64))
                last = number
        if found.rows:
            yield from counted(found)

    return merge


def count_runs(k: int):
    """``mapInArrow`` function from ``(bin, run)`` in order of the bins to packed k-mers and their counts.

    Whole bins are spelled out together, about ``RUN_WINDOWS`` windows. One that
    has more is gone through several times, for another part of its k-mers
    each time, so that only its runs are held and not its k-mers.
    """
    names = [*word_names(k), "cnt"]
    table = base_codes()

    def counted(held: list[np.ndarray], windows: int):
        parts = -(-windows // RUN_WINDOWS)
        for part in range(parts):
            found = []
            for text in held:
                for words in whole_kmers(text, k, table):
                    if parts > 1:
                        own = (mixed(words) >> np.uint64(33)) % np.uint64(parts) == np.uint64(part)
                        words = [w[own] for w in words]
                    found.append(words)
            words, cnt = distinct_rows([np.concatenate(w) for w in zip(*found)])
            for at in range(0, len(cnt), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + ROWS]) for c in (*words, cnt)], names)

    def count(batches):
        held, windows, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = batch.column(0).to_numpy()
            text, borders = text_and_offsets(batch.column(1))
            # A run of n bytes, the last of which is no base, has n - k windows.
            before = borders - k * np.arange(len(borders))
            at = 0
            for new in np.flatnonzero(np.append(bins[0] != last, bins[1:] != bins[:-1])).tolist():
                if windows + before[new] - before[at] >= RUN_WINDOWS:
                    held.append(text[borders[at] : borders[new]])
                    yield from counted(held, int(windows + before[new] - before[at]))
                    held, windows, at = [], 0, new
            held.append(text[borders[at] :].copy())
            windows, last = int(windows + before[-1] - before[at]), bins[-1]
        if windows:
            yield from counted(held, windows)

    return count


def count_batches(k: int):
    """``mapInArrow`` function from such a column to the distinct k-mers of one word and their counts.

    An array with a place for each of the 4**k words; about a quarter as many
    k-mers are gathered before they are added to it.
    """
    names = [*word_names(k), "cnt"]
    table = base_codes()

    def count(batches):
        counts = np.zeros(1 << 2 * k, np.int64)
        held, rows = [], 0
        for batch in batches:
            for (words,) in gathered_kmers(batch.column(0), k, table) if batch.num_rows else ():
                held.append(words)
                rows += len(words)
                if rows >= max(ROWS, len(counts) // 4):
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, rows = [], 0
        if rows:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        seen = np.flatnonzero(counts)
        for at in range(0, len(seen), ROWS):
            some = seen[at : at + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names)

    return count
