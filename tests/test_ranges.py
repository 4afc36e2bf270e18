"""Byte-range readers, without Spark."""

import gzip
import io
import random
import struct
import zlib
from collections import Counter

import pytest
from kmer_cases import brute_kmers, random_seqs

from merscope.sources import ranges

RNG = random.Random(31)


@pytest.fixture(autouse=True)
def small_reads(monkeypatch):
    """Reads of a few bytes, so that everything lies on some border."""
    monkeypatch.setattr(ranges, "CHUNK", 13)
    monkeypatch.setattr(ranges, "LOOK_BACK", 3)
    monkeypatch.setattr(ranges, "TILE", 16)


def cuts(size, count):
    inner = sorted(RNG.sample(range(1, size), min(count, size - 1))) if size > 1 else []
    return list(zip([0, *inner], [*inner, size]))


def read(data, kind, parts, k=5, compressed=False):
    found = []
    for start, end in parts:
        for batch in ranges.sequences(io.BytesIO(data), kind, start, end, k, compressed, "x"):
            found += batch
    return [s.decode() for s in found]


def wrapped(seq, width, newline):
    return newline.join(seq[i : i + width] for i in range(0, len(seq), width))


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("k", [1, 2, 9, 33])
@pytest.mark.parametrize("width", [7, 10**6])
def test_fasta_at_any_borders(newline, k, width):
    for count in (0, 1, 5, 40, 400):
        seqs = random_seqs(RNG, 6, 0, 150, "ACGTacgtN")
        text = "".join(f">s{i} has>another{newline}{wrapped(s, width, newline)}{newline}" for i, s in enumerate(seqs))
        assert brute_kmers(read(text.encode(), "fasta", cuts(len(text), count), k), k) == brute_kmers(seqs, k)


@pytest.mark.parametrize("text,seqs", [
    (">a\nACGT\nAC\n", ["ACGTAC"]),
    (">a\n\n\nACGT\n\nAC\n", ["ACGTAC"]),
    (">a\n>b\nACG\n>c\n", ["ACG"]),
    ("no header\nACGTA\n", ["ACGTA"]),
    ("\nACGTA\n", ["ACGTA"]),
    ("ACGTA", []),
    (">a\nACGTA>b\nCCG", ["ACGTA", "CCG"]),
    (">a\nAC@GTA+CCGGA\n", ["AC", "GTA", "CCGGA"]),
    (">a\nACNGTARYCCU GGA\n", ["AC", "GTA", "CC", "GGA"]),
])
def test_fasta_cases(text, seqs):
    for count in range(len(text)):
        assert brute_kmers(read(text.encode(), "fasta", cuts(len(text), count), 3), 3) == brute_kmers(seqs, 3)


def records(count, low=0, high=40):
    seqs = random_seqs(RNG, count, low, high, "ACGTN")
    return [(f"r{i} x@y+z", s, "".join(RNG.choices("@+>IACGT", k=len(s)))) for i, s in enumerate(seqs)]


def fastq(rows, newline="\n", plus=""):
    return "".join(newline.join([f"@{name}", s, f"+{plus}", q]) + newline for name, s, q in rows)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("plus", ["", "same"])
def test_fastq_at_any_borders(newline, plus):
    for count in (0, 1, 4, 30, 300):
        rows = records(25, 1)
        text = fastq(rows, newline, plus)
        assert Counter(read(text.encode(), "fastq", cuts(len(text), count))) == Counter(s for _, s, _ in rows)


def test_fastq_cut_short_or_with_blank_lines():
    text = fastq([("a", "ACGTA", "@IIII"), ("b", "GGGTA", "+IIII")])
    for cut in [text, text[:-1], text[:-6], text[:-7], text[:-8], text[:-9], text + "\n\n", "\n" + text]:
        for count in (0, 1, 3, 8):
            assert Counter(read(cut.encode(), "fastq", cuts(len(cut), count))) == Counter(["ACGTA", "GGGTA"]), (cut, count)


def test_fastq_over_several_lines_is_refused():
    with pytest.raises(ValueError, match="FASTQ record without"):
        read(b"@a\nACGT\nACGT\n+\nIIII\nIIII\n", "fastq", [(0, 26)])


def members(text, sizes):
    """Gzip members over pieces of a text, whose borders fall anywhere in its records."""
    out, at = b"", 0
    while at < len(text):
        size = RNG.choice(sizes)
        out += gzip.compress(text[at : at + size].encode())
        at += size
    return out


def block_gzip(text, size):
    """Members with their own length in an extra field, and an empty one at the end."""
    out = b""
    for at in [*range(0, len(text), size), len(text)]:
        engine = zlib.compressobj(6, zlib.DEFLATED, -15)
        piece = text[at : at + size].encode()
        body = engine.compress(piece) + engine.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25)
        out += head + body + struct.pack("<II", zlib.crc32(piece), len(piece))
    return out


@pytest.mark.parametrize("sizes", [[10**6], [1], [40, 7], [300]])
def test_gzip_members_at_any_borders(sizes):
    rows = records(30, 1)
    text = fastq(rows)
    for data in (members(text, sizes), block_gzip(text, sizes[0])):
        for count in (0, 1, 7, 60):
            got = read(data, "fastq", cuts(len(data), count), compressed=True)
            assert Counter(got) == Counter(s for _, s, _ in rows)


def test_gzip_members_are_shared_out():
    """More than one range has members to read."""
    rows = records(60, 20)
    data = members(fastq(rows), [200])
    busy = [bool(read(data, "fastq", [part], compressed=True)) for part in cuts(len(data), 3)]
    assert sum(busy) >= 3


def test_gzip_fasta_and_padding_and_plain_content():
    seqs = random_seqs(RNG, 9, 0, 90)
    text = "".join(f">x\n{wrapped(s, 11, chr(10))}\n" for s in seqs)
    for data in (members(text, [50]), members(text, [10**6]) + bytes(512), text.encode()):
        assert brute_kmers(read(data, "fasta", [(0, len(data))], compressed=True), 5) == brute_kmers(seqs, 5)
    rows = records(10, 1)
    text = fastq(rows).encode()
    assert Counter(read(text, "fastq", cuts(len(text), 5), compressed=True)) == Counter(s for _, s, _ in rows)


def test_a_member_cut_short_is_an_error():
    data = gzip.compress(fastq(records(40, 5)).encode())[:-20]
    with pytest.raises((EOFError, zlib.error)):
        read(data, "fastq", [(0, len(data))], compressed=True)


def test_a_line_of_any_length_takes_bounded_memory(monkeypatch):
    """A sequence line is never held whole: no piece handed on is longer than a tile or a read."""
    monkeypatch.setattr(ranges, "CHUNK", 1 << 12)
    monkeypatch.setattr(ranges, "TILE", 1 << 11)
    line = "".join(RNG.choices("ACGT", k=3_000_000))
    text = f">chromosome\n{line}\n".encode()
    longest, total = 0, 0
    for start, end in cuts(len(text), 9):
        for batch in ranges.fasta_range(io.BytesIO(text), start, end, 21):
            longest = max(longest, *map(len, batch))
            total += sum(len(t) - 20 for t in batch)
    # One window more: the header counts as a symbol that ends a segment.
    assert longest <= (1 << 11) + 20 and total == len(line) - 20 + 1
