"""The hash families over NumPy arrays: the same numbers as the column functions.

Arithmetic on ``uint64`` arrays wraps around, which is what both families need.
"""

from __future__ import annotations

import math

import numpy as np

from merscope.functions.hashing import COPY_STEP, REHASH, multiply_parameters

# The five primes of the 64-bit xxHash, and Spark's seed.
# And those of MD5: shifts of its four rounds, the sine table, and the first state.
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
# Messages digested at a time, so that the arrays stay in the CPU's cache.
MESSAGES = 1 << 13

PRIMES = np.array(
    [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64
)
SPARK_SEED = 42


def rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xx_of_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """xxHash of one 64-bit number, as Spark's ``xxhash64`` chains it over its arguments."""
    p1, p2, p3, p4, p5 = PRIMES
    x = seed + (p5 + np.uint64(8)) ^ rotated(value * p2, 31) * p1
    x = rotated(x, 27) * p1 + p4
    x = (x ^ (x >> np.uint64(33))) * p2
    x = (x ^ (x >> np.uint64(29))) * p3
    return x ^ (x >> np.uint64(32))


def xx_hash(words: list[np.ndarray], copy: int, seed: int) -> np.ndarray:
    """63-bit hash of packed k-mers."""
    start = np.array([(seed * COPY_STEP + copy) % (1 << 64)], np.uint64)
    h = xx_of_long(start, np.array([SPARK_SEED], np.uint64))
    for word in words:
        h = xx_of_long(word.view(np.uint64), h)
    return h >> np.uint64(1)


def xx_rehash(h: np.ndarray, copy: int, seed: int) -> np.ndarray:
    """32 bits that decide column and fingerprint."""
    mixed = xx_of_long(h, np.array([SPARK_SEED], np.uint64))
    return xx_of_long(np.array([REHASH], np.uint64), mixed) >> np.uint64(32)


def multiply_rehash(h: np.ndarray, copy: int, seed: int) -> np.ndarray:
    """The upper half of ``odd * h + add`` modulo 2**64."""
    odd, add = multiply_parameters(copy, seed)
    return (h * np.uint64(odd) + np.uint64(add)) >> np.uint64(32)


def md5_block(state: list[np.ndarray], m: np.ndarray) -> list[np.ndarray]:
    """The state after one block of 64 bytes of each message, ``m`` its 16 words."""
    a, b, c, d = state
    for i in range(64):
        kind = i // 16
        if kind == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif kind == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif kind == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += m[g]
        f += np.uint32(SINES[i])
        turn = TURNS[kind][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
    return [x + y for x, y in zip(state, (a, b, c, d))]


def md5_words(prefix: bytes, texts: np.ndarray) -> list[np.ndarray]:
    """MD5 of ``prefix`` and each row of bytes: the four 32-bit groups of its hex digits."""
    size = len(prefix) + texts.shape[1]
    padded = np.zeros((len(texts), -(-(size + 9) // 64) * 64), np.uint8)
    padded[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
    padded[:, len(prefix) : size] = texts
    padded[:, size] = 0x80
    padded[:, -8:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
    words = np.ascontiguousarray(padded.view("<u4").T)
    state = [np.full(len(texts), x, np.uint32) for x in STATE]
    for at in range(0, len(words), 16):
        state = md5_block(state, words[at : at + 16])
    return [x.byteswap() for x in state]


def md5_hash(texts: np.ndarray, copy: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``h`` and ``u`` of k-mers, each a row of letters: digits 1-15 and 17-24, as ``hash_with_md5`` reads them."""
    prefix = (f"{seed}:" if seed else "") + f"{copy}:"
    found = [md5_words(prefix.encode(), texts[at : at + MESSAGES]) for at in range(0, len(texts), MESSAGES)]
    first, second, third, _ = (np.concatenate(x).astype(np.uint64) for x in zip(*found))
    return first << np.uint64(28) | second >> np.uint64(4), third


# ``hash(words, copy, seed)`` and ``rehash(h, copy, seed)`` of each family that has packed k-mers.
ARRAY_FAMILIES = {"xxhash64": (xx_hash, xx_rehash), "multiply": (xx_hash, multiply_rehash)}
