"""Token ids of texts by a public tokenizer."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts made of these symbols alone are cut into pieces here, as the
# tokenizer's own pattern cuts them; anything else it gets to see itself.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
# White space to Python but not to the tokenizer.
SEPARATORS = re.compile(r"[\x1c-\x1f]")
JOINED = 1_000
# Symbols of the texts whose new words are learned together.
GROUP = 1 << 18
# Chunks and pieces that a generation remembers, together; there are two.
MOST_CHUNKS, MOST_PIECES = 150_000, 100_000
# Longer chunks are not remembered, so that the bound on their number is one on their bytes.
LONGEST = 256
# Bytes that are cut in arrays at a time, up to the next white space.
STRETCH = 1 << 21
# Pieces that the table of arrays remembers; of a full one the more frequent half stays.
MOST_ROWS = 400_000
# What a byte is to the tokenizer's pattern; an odd one sends its whole chunk to the tokenizer.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
KINDS = np.full(256, ODD, np.uint8)
KINDS[0x21:0x7F] = OTHER
for some, kind in ((b"\t\n\v\f\r ", SPACE), (bytes(range(65, 91)) + bytes(range(97, 123)), LETTER), (b"0123456789", DIGIT)):
    KINDS[list(some)] = kind
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
SPACE_BYTE = re.compile(rb"[\t-\r ]")


def cut_pieces(text: bytes) -> tuple[pa.StringArray, np.ndarray, bool]:
    """The pieces of a text in UTF-8, where each begins, and whether odd chunks are among them.

    What ``PLAIN`` and ``PIECES`` say of symbols, on arrays of bytes. A chunk
    with anything else in it, or with the beginning of a special token, is one
    piece as it stands.
    """
    raw = np.frombuffer(text + b"   ", np.uint8)
    kind, low = KINDS[raw], LOWER[raw]
    latin = np.flatnonzero(raw == 0xC3)
    latin = latin[(raw[latin + 1] & 0xC0 == 0x80) & (raw[latin + 1] & 0xDF != 0x97)]
    kind[latin] = kind[latin + 1] = LETTER
    low[latin + 1] |= 0x20
    low[latin[raw[latin + 1] == 0x9F] + 1] = 0x9F
    special = np.flatnonzero(raw == ord("<"))
    kind[special[raw[special + 1] == ord("|")]] = ODD
    odd = kind == ODD
    if has_odd := bool(odd.any()):
        chunk = np.cumsum(kind == SPACE, dtype=np.int32)
        held = np.zeros(len(raw) + 1, bool)
        held[chunk[odd]] = True
        whole = held[chunk] & (kind != SPACE)
        kind[whole] = ODD
        low[whole] = raw[whole]
    begins = kind == DIGIT
    begins[0] = kind[0] != SPACE
    begins[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != SPACE)
    quote = np.flatnonzero((raw == ord("'")) & begins & (kind == OTHER))
    first, second = low[quote + 1], low[quote + 2]
    one = quote[np.isin(first, list(b"stmd"))]
    two = quote[((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))]
    begins[one + 1] = begins[two + 1] = False
    for behind in (one + 2, two + 3):
        begins[behind[kind[behind] == LETTER]] = True
    kept = kind != SPACE
    own = low[kept]
    offsets = np.append(np.flatnonzero(begins[kept]), len(own)).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(own))
    return pieces, np.flatnonzero(begins), has_odd


class CachedEncoder:
    """The ids a word-level tokenizer gives, with each distinct word encoded once.

    The tokenizer drops white space and never merges across it, so the ids of
    a text are those of its chunks between white space, and the ids of a chunk
    are those of the pieces its pattern finds. Both are remembered in one
    table, up to a bound, as little-endian bytes: a piece that stands alone is
    a chunk of the same ids. A full table becomes the generation before, of
    which the words that come again are taken over. Most words of a large input come
    once: the tables stay small, and what comes often is never forgotten.
    :meth:`encode_column` does the same for many texts with pieces in arrays.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for pieces, which come lower-cased and cut: its pattern need not run again.
        self.of_pieces = Tokenizer(self.tokenizer.model)
        self.of_pieces.normalizer = normalizers.Sequence([])
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.of_pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), to_bytes])
        ends = {i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")}
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[list(ends)] = True
        self.chunks: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        # What encode_column remembers: pieces, their numbers of ids, how many stretches had them, and all ids in their order.
        self.pieces = pa.array([], pa.string())
        self.sizes = self.uses = np.empty(0, np.int64)
        self.ids = np.empty(0, "<u4")

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_some(self, pieces: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Many pieces in one call, told apart by the ids that end a word: pieces, their ids and where each one's end."""
        for at in range(0, len(pieces), JOINED):
            some = pieces[at : at + JOINED]
            ids = np.array(self.of_pieces.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(some):
                each = [self.direct(p) for p in some]
                ids, ends = np.frombuffer(b"".join(each), "<u4"), np.cumsum([len(raw) // 4 for raw in each])
            yield some, ids, ends

    def encode_pieces(self, pieces: list[str]) -> None:
        for some, ids, ends in self.encode_some(pieces):
            raw, borders = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.chunks.update(zip(some, [raw[a:b] for a, b in zip(borders, borders[1:])], strict=True))

    def unknown(self, words: set[str]) -> set[str]:
        """Those of the words that have to be learned; what the generation before knows is taken over."""
        fresh = words.difference(self.chunks)
        back = self.before.keys() & fresh
        self.chunks.update([(w, self.before[w]) for w in back])
        return fresh - back

    def turn(self) -> None:
        if len(self.chunks) > MOST_CHUNKS + MOST_PIECES:
            self.before, self.chunks = self.chunks, {}

    def learn(self, chunks: set[str]) -> None:
        """Steps on all chunks at once: most words of a large input are new, so what a new one costs counts."""
        known = self.chunks
        plain = [c for c in chunks if PLAIN.fullmatch(c)]
        if "<|" in " ".join(plain):
            plain = [c for c in plain if "<|" not in c]
        if len(plain) < len(chunks):
            known.update((c, self.direct(c)) for c in chunks.difference(plain))
        # These symbols are lower-cased one by one, wherever they stand.
        lower = " ".join(plain).lower().split()
        alone = [low for low in lower if low.isalpha()]
        cut = [(c, PIECES.findall(low)) for c, low in zip(plain, lower, strict=True) if not low.isalpha()]
        self.encode_pieces(list(self.unknown(set(alone).union(chain.from_iterable(pieces for _, pieces in cut)))))
        known.update((c, known[low]) for c, low in zip(plain, lower) if c != low and low.isalpha())
        known.update([(c, b"".join([known[p] for p in pieces])) for c, pieces in cut if len(pieces) != 1 or pieces[0] != c])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if SEPARATORS.search(text):
            return self.direct(text)
        words = text.split()
        try:
            return b"".join([self.chunks[w] for w in words])
        except KeyError:
            self.turn()
            self.learn(self.unknown({w for w in words if len(w) <= LONGEST}))
            return b"".join([self.chunks[w] if w in self.chunks else self.relearn(w) for w in words])

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """:meth:`encode` of each text; what is new in a group of texts is learned at once."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self.encode_group(held)
                held, size = [], 0
        yield from self.encode_group(held)

    def encode_group(self, texts: list[str]) -> Iterator[bytes]:
        words = [None if SEPARATORS.search(text) else text.split() for text in texts]
        self.turn()
        fresh = self.unknown(set().union(*(w for w in words if w)))
        self.learn({w for w in fresh if len(w) <= LONGEST})
        known = self.chunks.__getitem__
        for text, own in zip(texts, words, strict=True):
            if own is None:
                yield self.direct(text)
                continue
            try:
                yield b"".join(map(known, own))
            except KeyError:
                yield b"".join([self.chunks[w] if w in self.chunks else self.relearn(w) for w in own])

    def encode_column(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin and the last one's end.

        Pieces are cut, told apart and looked up in arrays: only those that
        are new are strings to Python. Texts go by stretches, which end at
        white space, also within a long text.
        """
        whole = "\n".join(texts).encode() + b"\n" * bool(texts)
        ends = np.cumsum([1 + (len(text) if text.isascii() else len(text.encode())) for text in texts], dtype=np.int64)
        borders, parts = np.zeros(len(texts) + 1, np.int64), [np.empty(0, "<u4")]
        at = before = done = 0
        while at < len(whole):
            # The last byte is white space.
            end = SPACE_BYTE.search(whole, min(at + STRETCH, len(whole)) - 1).end()
            ids, begins, until = self.encode_stretch(whole[at:end])
            over = int(np.searchsorted(ends, end, side="right"))
            borders[done + 1 : over + 1] = before + until[np.searchsorted(begins, ends[done:over] - at)]
            parts.append(ids)
            at, before, done = end, before + len(ids), over
        return np.concatenate(parts), borders

    def encode_stretch(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of a text, where its pieces begin, and how many ids come before each piece and in all."""
        pieces, begins, has_odd = cut_pieces(text)
        found = pieces.dictionary_encode()
        row = self.rows(found.dictionary, has_odd)[found.indices.to_numpy()]
        sizes = self.sizes[row]
        until = np.append(0, np.cumsum(sizes))
        # From a place in the text's ids to the one in the table's.
        shift = (np.cumsum(self.sizes) - self.sizes)[row] - until[:-1]
        return self.ids[np.arange(until[-1]) + np.repeat(shift, sizes)], begins, until

    def rows(self, distinct: pa.StringArray, has_odd: bool) -> np.ndarray:
        """The row of the table that each of the pieces has; new ones get one."""
        self.forget()
        known = pc.index_in(distinct, value_set=self.pieces)
        new = known.is_null().to_numpy(zero_copy_only=False)
        row = known.fill_null(0).to_numpy().astype(np.int64)
        self.uses[row[~new]] += 1
        row[new] = len(self.pieces) + np.arange(new.sum())
        words = distinct.filter(known.is_null()).to_pylist()
        strange = {w for w in words if "<|" in w or not PLAIN.fullmatch(w)} if has_odd else set()
        # Odd chunks first, then the pieces: rows are given in that order.
        if strange:
            order = np.argsort([w not in strange for w in words], kind="stable")
            row[np.flatnonzero(new)[order]] = len(self.pieces) + np.arange(len(words))
            words = [words[k] for k in order]
        each = [np.frombuffer(raw, "<u4") for raw in self.encode_all(words[: len(strange)])]
        sizes, ids = [np.array([len(x) for x in each], np.int64)], [self.ids, *each]
        for _, some, ends in self.encode_some(words[len(strange) :]):
            sizes.append(np.diff(ends, prepend=0))
            ids.append(some)
        self.pieces = pa.concat_arrays([self.pieces, pa.array(words, pa.string())])
        self.sizes = np.concatenate([self.sizes, *sizes])
        self.uses = np.append(self.uses, np.zeros(len(words), np.int64))
        self.ids = np.concatenate(ids)
        return row

    def forget(self) -> None:
        """Long pieces leave the table after their stretch, and of too many rows those that fewest stretches had."""
        kept = pc.less_equal(pc.binary_length(self.pieces), LONGEST).to_numpy(zero_copy_only=False)
        if full := len(kept) > MOST_ROWS:
            kept[np.argsort(-self.uses, kind="stable")[MOST_ROWS // 2 :]] = False
        if kept.all():
            return
        self.ids = self.ids[np.repeat(kept, self.sizes)]
        self.pieces, self.sizes, self.uses = self.pieces.filter(pa.array(kept)), self.sizes[kept], self.uses[kept] >> full

    def relearn(self, chunk: str) -> bytes:
        """A chunk that is too long to be remembered, or was forgotten when the bound was reached."""
        if len(chunk) > LONGEST:
            return self.direct(chunk)
        self.learn({chunk})
        return self.chunks[chunk]
