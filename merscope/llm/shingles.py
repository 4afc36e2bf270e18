"""Sets of word shingles as 64-bit hashes, straight from the bytes of an Arrow column.

Texts are worked on in groups of about ``GROUP_BYTES``, a longer text in
stretches of that size, so that what is kept beside the words of one text does
not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from merscope.functions.arrow import text_and_offsets

WIDTH = 4
GROUP_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
MODULUS = 1 << 64
# Any odd numbers do; one for each place in a shingle.
PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
BYTES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, np.uint64)
BYTES[65:91] = BYTES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, made when first asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            inverse = np.uint64(pow(int(BASE), -1, MODULUS))
            size = max(n, 2 * GROUP_BYTES)
            self.up, self.down = (
                np.cumprod(np.append(np.ones(1, np.uint64), np.full(size, b, np.uint64))) for b in (BASE, inverse)
            )
        return self.up[:n], self.down[:n]


POWERS = Powers()


def word_values(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of concatenated texts, A-Z lowered: its polynomial, length, start and end.

    ``begins`` are the offsets of the texts; a word never crosses one.
    """
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[begins] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = POWERS.get(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTES[raw] * up[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts], (ends - starts).astype(np.uint64), starts, ends


def words_of_long(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text, in stretches; a word cut by one goes on in the next."""
    found, held, length = [], 0, 0
    for at in range(0, len(raw), GROUP_BYTES):
        part = raw[at : at + GROUP_BYTES]
        values, lengths, starts, ends = word_values(part, np.zeros(1, np.int64))
        if length and len(starts) and starts[0] == 0:
            values[0] = (held + pow(int(BASE), length, MODULUS) * int(values[0])) % MODULUS
            lengths[0] += np.uint64(length)
        elif length:
            values, lengths = np.append(np.uint64(held), values), np.append(np.uint64(length), lengths)
        held, length = 0, 0
        if len(ends) and ends[-1] == len(part):
            held, length = int(values[-1]), int(lengths[-1])
            values, lengths = values[:-1], lengths[:-1]
        found.append(mix(values + lengths))
    if length:
        found.append(mix(np.array([(held + length) % MODULUS], np.uint64)))
    return np.concatenate([np.zeros(0, np.uint64), *found])


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """One hash a shingle, from those of its words in their places."""
    out = np.empty(max(0, len(words) - WIDTH + 1), np.uint64)
    for at in range(0, len(out), GROUP_BYTES // 8):
        part = out[at : at + GROUP_BYTES // 8]
        part[:] = 0
        for place, factor in enumerate(PLACES):
            part += words[at + place : at + place + len(part)] * factor
        part[:] = mix(part)
    return out


def set_of(words: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    if len(words) >= WIDTH:
        return np.unique(shingles)
    if len(words):
        return mix((words * PLACES[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    return np.zeros(0, np.uint64)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct hashes of its shingles.

    A text of fewer words than a shingle has one of all of them; one without
    words, or null, has none.
    """
    raw, borders = text_and_offsets(column)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(borders, borders[at] + GROUP_BYTES, "right")) - 1)
        yield from sets_of_group(raw[borders[at] : borders[stop]], borders[at : stop + 1] - borders[at])
        at = stop


def sets_of_group(raw: np.ndarray, borders: np.ndarray) -> Iterator[np.ndarray]:
    if len(raw) > GROUP_BYTES:
        words = words_of_long(raw)
        yield set_of(words, shingle_hashes(words))
        return
    values, lengths, starts, _ = word_values(raw, borders[:-1])
    words = mix(values + lengths)
    shingles = shingle_hashes(words)
    places = np.searchsorted(starts, borders)
    for lo, hi in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        yield set_of(words[lo:hi], shingles[lo : max(lo, hi - WIDTH + 1)])
