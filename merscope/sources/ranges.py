"""Sequence files read by byte ranges, in bounded memory.

A file is cut into ranges that need not know of each other. The reader of a
FASTA range finds out from the bytes before it whether it begins inside a
header, and reads on behind its end for the k-1 symbols its last windows need;
a line may be of any length. The reader of a FASTQ range takes the records
whose header follows a line end in its range. Gzip files may hold several
members; a FASTQ range then stands for the members that begin in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

from merscope.sources.fasta import letters

# Bytes read at once, and the first step back in search of a line end or on behind a range.
CHUNK = 1 << 20
LOOK_BACK = LOOK_AHEAD = 1 << 14
TILE = 1 << 15
NEWLINE, RETURN, HEADER, PLUS, AT = 0x0A, 0x0D, 0x3E, 0x2B, 0x40
GZIP_MAGIC = b"\x1f\x8b"
# A gzip member: magic, deflate, and flags whose upper three bits are not in use.
MEMBER = b"\x1f\x8b\x08"
MEMBER_FLAGS = 0xE0


def chunks(file: BinaryIO, start: int, stop: int | None = None) -> Iterator[bytes]:
    """The bytes of ``[start, stop)``, or from ``start`` on; then a little first, as that may do."""
    file.seek(start)
    size = CHUNK if stop is not None else min(LOOK_AHEAD, CHUNK)
    while stop is None or start < stop:
        data = file.read(size if stop is None else min(size, stop - start))
        if not data:
            return
        start += len(data)
        size = min(4 * size, CHUNK)
        yield data


# --- FASTA ---------------------------------------------------------------------


def begins_in_header(file: BinaryIO, start: int) -> bool:
    """Whether the byte at ``start`` belongs to a header line.

    Looked up backwards: a ``>`` with no line end behind it says yes, a line
    end with no ``>`` behind it no. The first line of a file is a header.
    """
    step = LOOK_BACK
    while start > 0:
        low = max(0, start - step)
        file.seek(low)
        data = file.read(start - low)
        line = max(data.rfind(b"\n"), data.rfind(b"\r"))
        if data.find(b">", line + 1) >= 0:
            return True
        if line >= 0:
            return False
        start, step = low, min(step * 4, CHUNK)
    return True


class FastaSymbols:
    """Bases and breaks of consecutive bytes: headers become one N, line ends nothing."""

    def __init__(self, in_header: bool):
        self.in_header = in_header
        self.table = letters()

    def take(self, data: bytes) -> bytes:
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero((raw == NEWLINE) | (raw == RETURN))
        marks = np.flatnonzero(raw == HEADER)
        lines, first = np.unique(np.searchsorted(ends, marks), return_index=True)
        begins = marks[first]
        if self.in_header:
            # Up to the first line end all is header; marks in it begin nothing.
            begins = np.append(0, begins[lines > 0])
            lines = np.append(0, lines[lines > 0])
        stops = np.append(ends, len(raw))[lines]
        if len(raw):
            self.in_header = len(lines) > 0 and int(lines[-1]) == len(ends)
        change = np.zeros(len(raw) + 1, np.int32)
        np.add.at(change, begins, 1)
        np.add.at(change, stops, -1)
        kept = np.cumsum(change[:-1]) == 0
        kept[ends] = False
        out = self.table[raw]
        own = begins[begins < stops]
        out[own] = ord("N")
        kept[own] = True
        return out[kept].tobytes()


def tiles(symbols: Iterator[bytes], k: int) -> Iterator[list[bytes]]:
    """The symbols in tiles that overlap by k-1, a list for each piece that comes."""
    held, tile = b"", max(TILE, k)
    for piece in symbols:
        held += piece
        whole = max(0, (len(held) - (k - 1)) // tile)
        if whole:
            yield [held[i * tile : (i + 1) * tile + k - 1] for i in range(whole)]
            held = held[whole * tile :]
    if len(held) >= k:
        yield [held]


def fasta_range(file: BinaryIO, start: int, end: int, k: int) -> Iterator[list[bytes]]:
    """Tiles of all windows of ``k`` symbols that begin in ``[start, end)``."""

    def symbols() -> Iterator[bytes]:
        reader = FastaSymbols(begins_in_header(file, start))
        for data in chunks(file, start, end):
            yield reader.take(data)
        missing = k - 1
        if reader.in_header or missing == 0:
            return
        for data in chunks(file, end):
            # What follows a header is no part of any window that began before it.
            mark = data.find(b">")
            found = reader.take(data if mark < 0 else data[:mark])[:missing]
            yield found
            missing -= len(found)
            if mark >= 0 or missing == 0:
                return

    return tiles(symbols(), k)


def fasta_stream(data: Iterator[bytes], k: int) -> Iterator[list[bytes]]:
    """Tiles of a whole file whose bytes come one after the other."""
    reader = FastaSymbols(True)
    return tiles((reader.take(piece) for piece in data), k)


# --- FASTQ ---------------------------------------------------------------------


def first_record(text: bytes, at: int, last: bool) -> int | None:
    """Offset of the first record header behind a line end at or after ``at``.

    A line that begins with ``@`` is a header if the line after the next one
    begins with ``+``; behind a quality line that begins so stand a header and
    bases. None where more text is needed to tell; the length of the text if
    there is no more and no header.
    """
    while True:
        at = text.find(b"\n@", at)
        if at < 0:
            return len(text) if last else None
        begin = at + 1
        second = text.find(b"\n", begin)
        third = text.find(b"\n", second + 1) if second >= 0 else -1
        if third < 0 or third + 1 >= len(text):
            if not last:
                return None
            # A record cut short: its quality, and maybe its plus, is missing.
            return begin if second >= 0 and text[second + 1 : second + 2] not in (b"@", b"+") else len(text)
        if text[third + 1] == PLUS:
            return begin
        at = begin


def bases_of_line(text: bytes, start: int, end: int) -> bytes:
    return text[start : end - 1] if end > start and text[end - 1] == RETURN else text[start:end]


def parse_records(text: bytes, limit: int, last: bool, name: str) -> tuple[list[bytes], int, bool]:
    """Bases of the complete records whose header begins at or before ``limit``.

    ``text`` begins with a record. Also returned: how much of it is used up,
    and whether the limit has been passed. With ``last`` there is no more
    text, and a record may be cut short behind its bases.
    """
    raw = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(raw == NEWLINE)
    starts = np.append(0, ends + 1)
    many = len(ends) // 4
    heads, plus = starts[0 : 4 * many : 4], starts[2 : 4 * many : 4]
    within = int(np.searchsorted(heads, limit, "right"))
    if many and (raw[heads] == AT).all() and (raw[plus] == PLUS).all():
        found = [bases_of_line(text, s, e) for s, e in zip(starts[1 : 4 * within : 4].tolist(), ends[1 : 4 * within : 4].tolist())]
        used = int(starts[4 * within])
        if within < many or not last:
            return found, used, within < many
    else:
        found, used = [], 0
    more, used, passed = parse_one_by_one(text, used, limit, last, name)
    return found + more, used, passed


def parse_one_by_one(text: bytes, at: int, limit: int, last: bool, name: str) -> tuple[list[bytes], int, bool]:
    """As :func:`parse_records`, for text with blank lines, odd records or an end."""
    found = []
    while at < len(text):
        if text[at] in (NEWLINE, RETURN):
            at += 1
            continue
        if at > limit:
            return found, at, True
        lines, to = [], at
        while len(lines) < 4 and to <= len(text):
            end = text.find(b"\n", to)
            if end < 0:
                if last and to < len(text):
                    lines.append((to, len(text)))
                    to = len(text) + 1
                break
            lines.append((to, end))
            to = end + 1
        if len(lines) < 4 and not last:
            break
        if text[at] != AT or (len(lines) > 2 and text[lines[2][0] : lines[2][0] + 1] not in (b"+", b"", b"\n", b"\r")):
            raise ValueError(f"FASTQ record without a '+' line after its bases in {name}")
        if len(lines) > 1:
            found.append(bases_of_line(text, *lines[1]))
        at = min(to, len(text))
    return found, at, False


def fastq_text(pieces: Iterator[tuple[bytes, bool]], whole: bool, name: str) -> Iterator[list[bytes]]:
    """Bases of the records that begin in the pieces marked as own.

    The text up to the first own line end belongs to whoever has the text
    before, unless it is the beginning of a file (``whole``); the record that
    begins right behind the last own byte belongs here.
    """
    held, limit, synced = b"", 0, whole
    pieces = iter(pieces)
    while True:
        data, own = next(pieces, (b"", False))
        last = not data
        held += data
        limit += len(data) if own else 0
        if not synced:
            at = first_record(held, 0, last)
            if at is None:
                # Nothing to find before the last own line end.
                if not own and held.rfind(b"\n@", 0, max(limit, 0) + 1) < 0:
                    return
                continue
            if at > limit or at == len(held):
                return
            held, limit, synced = held[at:], limit - at, True
        found, used, passed = parse_records(held, limit, last, name)
        if found:
            yield found
        held, limit = held[used:], limit - used
        if passed or last or limit < 0:
            return


def fastq_range(file: BinaryIO, start: int, end: int, name: str) -> Iterator[list[bytes]]:
    """Bases of the records whose header stands behind a line end in ``[start, end)``."""

    def pieces() -> Iterator[tuple[bytes, bool]]:
        for data in chunks(file, start, end):
            yield data, True
        for data in chunks(file, end):
            yield data, False

    return fastq_text(pieces(), start == 0, name)


# --- gzip ------------------------------------------------------------------------


def inflated(file: BinaryIO, start: int) -> Iterator[tuple[bytes, int]]:
    """Text of the gzip members from offset ``start`` on, with the offset of the member it is from."""
    member, at, fresh = start, start, True
    engine = zlib.decompressobj(wbits=31)
    for data in chunks(file, start):
        at += len(data)
        while data:
            if fresh and not data.startswith(GZIP_MAGIC[: len(data)]):
                # What follows the last member, such as padding, is no text.
                return
            fresh = False
            text = engine.decompress(data, CHUNK)
            if text:
                yield text, member
            data = engine.unused_data if engine.eof else engine.unconsumed_tail
            if engine.eof:
                member, fresh = at - len(data), True
                engine = zlib.decompressobj(wbits=31)
    if not fresh:
        text = engine.flush()
        if text:
            yield text, member
        if not engine.eof:
            raise EOFError("a gzip member ends before its data is complete")


def is_member(file: BinaryIO, start: int) -> bool:
    """Whether a whole gzip member begins at ``start``: it inflates, and its checksum and length agree."""
    engine = zlib.decompressobj(wbits=31)
    try:
        for data in chunks(file, start):
            while data and not engine.eof:
                engine.decompress(data, CHUNK)
                data = engine.unconsumed_tail
            if engine.eof:
                return True
    except zlib.error:
        pass
    return False


def first_member(file: BinaryIO, start: int, end: int) -> int | None:
    """Offset of the first gzip member that begins in ``[start, end)``."""
    if start == 0:
        return 0
    at, held = start, b""
    while at < end:
        file.seek(at)
        held = file.read(min(CHUNK, end - at) + len(MEMBER))
        found = held.find(MEMBER)
        while 0 <= found < end - at:
            flags = held[found + len(MEMBER) : found + len(MEMBER) + 1]
            if (not flags or not flags[0] & MEMBER_FLAGS) and is_member(file, at + found):
                return at + found
            found = held.find(MEMBER, found + 1)
        at += max(1, len(held) - len(MEMBER))
    return None


def gzip_fastq_range(file: BinaryIO, start: int, end: int, name: str) -> Iterator[list[bytes]]:
    """Bases of the records of the members that begin in ``[start, end)``, as in :func:`fastq_range`."""
    member = first_member(file, start, end)
    if member is None:
        return iter(())
    return fastq_text(((text, at < end) for text, at in inflated(file, member)), member == 0, name)


def sequences(file: BinaryIO, kind: str, start: int, end: int, k: int, compressed: bool, name: str) -> Iterator[list[bytes]]:
    """Sequences of one range. ``compressed`` files that do not begin as gzip are read as they are."""
    if compressed:
        file.seek(0)
        compressed = file.read(2) == GZIP_MAGIC
    if kind == "fasta":
        return fasta_stream((text for text, _ in inflated(file, 0)), k) if compressed else fasta_range(file, start, end, k)
    return gzip_fastq_range(file, start, end, name) if compressed else fastq_range(file, start, end, name)
