"""FASTA: records of any length, read line by line from splittable text.

A record can be a whole chromosome and a file can hold one record, so a record
is never gathered into a row. Each input split turns its lines into tiles that
overlap by k-1 bases; only the k-mers that cross from one split into the next
need rows from two tasks, and those are made from the first and last k-1 bases
of the splits, the only rows that are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merscope.functions.arrow import text_and_offsets
from merscope.functions.bases import BASES
from merscope.operators.segments import TILE, byte_slices, check_k

PIECE_SCHEMA = "file string, block bigint, piece bigint, seq string, head string"

# Longest slice of one line that is sent to a task's Python side at once.
SLICE = 1 << 13


def letters() -> np.ndarray:
    """Byte -> upper-case base, or N for everything that ends a segment."""
    table = np.full(256, ord("N"), np.uint8)
    for base in BASES:
        table[ord(base)] = table[ord(base.lower())] = ord(base)
    return table


def line_slices(lines: DataFrame) -> DataFrame:
    """Cut very long lines into ordered slices; ``bol`` marks a line's first."""
    slices = byte_slices(F.col("raw"), SLICE, SLICE, 0)
    return lines.select("file", "block", "shared", F.posexplode(slices).alias("at", "line")).select(
        "line", (F.col("at") == 0).alias("bol"), "file", "block", "shared"
    )


class SplitText:
    """Bases of one input split, cut into overlapping tiles as they arrive.

    With ``edges`` only its first and last k-1 bases are kept, as one row.
    """

    def __init__(self, file, block, edges, k, tile):
        self.file, self.block, self.edges = file, block, edges
        self.overlap, self.tile = k - 1, tile
        self.in_header = block == 0
        self.started = False
        self.pending = b""
        self.head = b""
        self.length = 0
        self.pieces = 0

    def add(self, text: bytes):
        if len(self.head) < self.overlap:
            self.head += text[: self.overlap - len(self.head)]
        self.length += len(text)
        if self.edges:
            self.pending = (self.pending + text)[-self.overlap :]
            return
        self.pending += text
        at = 0
        while len(self.pending) - at >= self.tile + self.overlap:
            yield self.row(self.pending[at : at + self.tile + self.overlap])
            at += self.tile
        self.pending = self.pending[at:]

    def finish(self):
        if self.edges and self.length:
            yield (self.file, self.block, None, self.pending.decode("ascii"), self.head.decode("ascii"))
        elif not self.edges and len(self.pending) > self.overlap:
            yield self.row(self.pending)

    def row(self, text: bytes):
        self.pieces += 1
        return (self.file, self.block, self.pieces, text.decode("ascii"), None)


def section_text(split, text, ends, bol, table) -> bytes:
    """Bases of consecutive slices of one split, each header replaced by N.

    A header runs from the first ``>`` of a line, wherever it stands, to the
    end of that line. ``ends`` holds the slice borders within ``text``.
    """
    line = np.cumsum(bol)
    line_stop = np.append(ends[:-1][bol], len(text))
    marks = np.flatnonzero(text == ord(">"))
    marked, first = np.unique(line[np.searchsorted(ends, marks, side="right") - 1], return_index=True)
    begin = marks[first]
    if split.in_header and not (split.started and bol[0]):
        # The line at the start is a header, or the rest of one.
        others = marked != line[0]
        marked = np.append(line[0], marked[others])
        begin = np.append(0, begin[others])
    split.started = True
    split.in_header = len(marked) > 0 and marked[-1] == line[-1]
    stop = line_stop[marked]
    begin, stop = begin[begin < stop], stop[begin < stop]
    change = np.zeros(len(text) + 1, np.int8)
    change[begin] = 1
    change[stop] -= 1
    kept = np.cumsum(change[:-1], dtype=np.int8) == 0
    kept[begin] = True
    letters_ = table[text]
    letters_[begin] = ord("N")
    return letters_[kept].tobytes()


def split_pieces(k: int, tile: int, edges: bool = False):
    """``mapInArrow`` function from line slices to tiles, or to split edges."""
    names = ["file", "block", "piece", "seq", "head"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    table = letters()

    def to_batch(rows):
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays(columns, names)

    def cut(batches):
        split = None
        for batch in batches:
            size = batch.num_rows
            if size == 0:
                continue
            data, ends = text_and_offsets(batch.column(0))
            bol = batch.column(1).to_numpy(zero_copy_only=False)
            files = batch.column(2).dictionary_encode()
            blocks = batch.column(3).to_numpy()
            moved = (np.diff(files.indices.to_numpy()) != 0) | (np.diff(blocks) != 0)
            borders = np.concatenate(([0], np.flatnonzero(moved) + 1, [size]))
            rows = []
            for first, last in zip(borders[:-1], borders[1:]):
                file, block = batch.column(2)[first].as_py(), int(blocks[first])
                if split is None or (split.file, split.block) != (file, block):
                    if split is not None:
                        rows.extend(split.finish())
                    split = SplitText(file, block, edges, k, tile)
                text = data[ends[first] : ends[last]]
                rows.extend(
                    split.add(section_text(split, text, ends[first : last + 1] - ends[first], bol[first:last], table))
                )
            if rows:
                yield to_batch(rows)
        if split is not None:
            rows = list(split.finish())
            if rows:
                yield to_batch(rows)

    return cut


def border_sequences(edges: DataFrame, k: int) -> DataFrame:
    """The text around the border of each split to the next one.

    The last k-1 bases of a split followed by the next k-1 bases of the file
    hold exactly the k-mers that cross this border first. Edges of one file
    form one group, a row of 2(k-1) bases per input split.
    """
    ahead = Window.partitionBy(F.xxhash64("file"), "file").orderBy("block").rowsBetween(1, max(1, k - 1))
    following = F.substring(F.array_join(F.collect_list("head").over(ahead), ""), 1, k - 1)
    return edges.select("file", F.concat("seq", following).alias("seq"))


def fasta_lines(raw: DataFrame) -> DataFrame:
    """Lines of text files with the input split each one came from."""
    meta = F.col("_metadata")
    return raw.select(
        F.col("value").cast("binary").alias("raw"),
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("block"),
        (meta["file_block_length"] < meta["file_size"]).alias("shared"),
    )


def fasta_sequences(lines: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    """``(file, seq)`` tiles of the records in :func:`fasta_lines`.

    Tiles stay where they are read. Files of several splits are read a second
    time for the edges of their splits alone, which are all that is shuffled.
    """
    check_k(k)
    tile = max(tile, k)
    tiles = line_slices(lines).mapInArrow(split_pieces(k, tile), PIECE_SCHEMA).select("file", "seq")
    if k == 1:
        return tiles
    shared = line_slices(lines.where("shared"))
    edges = shared.mapInArrow(split_pieces(k, tile, edges=True), PIECE_SCHEMA)
    return tiles.unionByName(border_sequences(edges, k))


def read_fasta(spark: SparkSession, paths: list[str], k: int, tasks: int | None = None, **options) -> DataFrame:
    """``reads(file, seq)``: tiles that hold every k-mer of the files once.

    Wrapped lines are joined, LF, CR and CRLF alike. The first line of a file
    is a header whether or not it begins with ``>``. With ``tasks``, that many
    read the input splits, one split after the other.
    """
    lines = fasta_lines(spark.read.options(**options).text(paths))
    return fasta_sequences(lines.coalesce(tasks) if tasks else lines, k)
