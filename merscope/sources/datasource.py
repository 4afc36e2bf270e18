"""``spark.read.format("merscope")``: FASTA and FASTQ files as a Spark data source.

Options: ``path`` (or ``files``, a JSON list of paths), each a file, a folder
or a pattern; ``k``, by whose k-1 the tiles of FASTA sequences overlap;
``format``, ``fasta`` or ``fastq``, where names do not say it; ``splitBytes``;
``tasks``, by which ranges are dealt out: where there are more of them, each
task reads several, as long as that is no more than ``SPLIT_BYTES``. Rows are ``(file, seq)``. Files are opened by the tasks, through PyArrow's file
systems where the path names one.
"""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from merscope.sources.formats import GZIP, SUFFIXES, file_format
from merscope.sources.ranges import sequences

NAME = "merscope"
SCHEMA = "file string, seq string"
SPLIT_BYTES = 64 << 20
TASKS = 256
PATTERN = set("*?[")
# Bytes above 127 are no bases; as one they end a segment like any other symbol.
ASCII_ONLY = bytes(range(128)) + b"N" * 128


def opened_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def prefix_of(path: str) -> str:
    """What the paths of a file system have to get in front to be opened later."""
    if "://" in path and not path.startswith("file:"):
        whole, inner = path, opened_system(path)[1]
        return whole.removesuffix(inner)
    return "file://"


def found_files(path: str) -> list[tuple[str, int]]:
    """``(path, bytes)`` of a file, of the files of a folder, or of those a pattern fits; hidden ones are left out."""
    system, inner = opened_system(path)
    if PATTERN & set(inner):
        folder, name = inner.rsplit("/", 1) if "/" in inner else (".", inner)
        if PATTERN & set(folder):
            raise ValueError(f"only the last part of {path} may be a pattern")
        kept = [i for i in system.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatchcase(i.base_name, name)]
    else:
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no such file: {path}")
        kept = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner))
    files = [i for i in kept if i.type == fs.FileType.File and (len(kept) == 1 or i.base_name[0] not in "._")]
    front = prefix_of(path)
    return sorted((front + i.path, i.size) for i in files)


@dataclass
class FileRange(InputPartition):
    path: str
    kind: str
    start: int
    end: int


def ranges_of(path: str, size: int, kind: str, split_bytes: int) -> list[FileRange]:
    """Ranges of one file. Compressed FASTA has one: what a line is part of stands before it."""
    if size == 0:
        return []
    if kind == "fasta" and path.endswith(GZIP):
        return [FileRange(path, kind, 0, size)]
    many = -(-size // split_bytes)
    return [FileRange(path, kind, size * i // many, size * (i + 1) // many) for i in range(many)]


@dataclass
class RangeGroup(InputPartition):
    """What one task reads."""

    ranges: list[FileRange]


def grouped_ranges(ranges: list[FileRange], tasks: int) -> list[RangeGroup]:
    """Consecutive ranges in about ``tasks`` groups of about as many bytes, more where these would exceed ``SPLIT_BYTES``.

    However small the ranges, the tasks, and with them the blocks of a shuffle that follows, do not outgrow the input.
    """
    size = sum(r.end - r.start for r in ranges)
    tasks = max(tasks, -(-size // SPLIT_BYTES))
    if len(ranges) <= tasks:
        return [RangeGroup([r]) for r in ranges]
    groups: dict[int, list[FileRange]] = {}
    before = 0
    for r in ranges:
        groups.setdefault(before * tasks // size, []).append(r)
        before += r.end - r.start
    return [RangeGroup(g) for g in groups.values()]


def range_batches(part: FileRange, k: int) -> Iterator[pa.RecordBatch]:
    system, inner = opened_system(part.path)
    file: BinaryIO = system.open_input_file(inner)
    with file:
        compressed = part.path.endswith(GZIP)
        for found in sequences(file, part.kind, part.start, part.end, k, compressed, part.path):
            ascii_only = [s if s.isascii() else s.translate(ASCII_ONLY) for s in found]
            columns = [pa.repeat(pa.scalar(part.path), len(found)), pa.array(ascii_only, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["file", "seq"])


class SequenceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.k = int(options.get("k", "1"))
        if self.k < 1:
            raise ValueError(f"k must be a positive integer, got {self.k}")
        self.format = options.get("format")
        if self.format is not None and self.format not in SUFFIXES:
            raise ValueError(f"format must be one of {sorted(SUFFIXES)}")
        self.split_bytes = int(options.get("splitBytes", str(SPLIT_BYTES)))
        self.tasks = int(options.get("tasks", str(TASKS)))
        self.paths = json.loads(options["files"]) if "files" in options else [options["path"]]

    def partitions(self) -> list[RangeGroup]:
        out = []
        for path in self.paths:
            for name, size in found_files(path):
                out += ranges_of(name, size, self.format or file_format(name), self.split_bytes)
        return grouped_ranges(out, self.tasks) or [RangeGroup([])]

    def read(self, partition: RangeGroup) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges:
            yield from range_batches(part, self.k)


class SequenceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SequenceReader:
        return SequenceReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SequenceFiles)
