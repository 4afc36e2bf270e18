"""Reading sequences from files by format, or from any other source."""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merscope.operators.segments import check_k
from merscope.sources import datasource
from merscope.sources.fasta import read_fasta
from merscope.sources.fastq import read_fastq
from merscope.sources.formats import SUFFIXES, file_format
from merscope.sources.spread import GZIP, GZIP_NAMES, OTHER_NAMES, spread, spread_gzip, tasks_of

# Hadoop picks a decompressor by file name; this one hands on the bytes of
# names ending in .gz as they are. Spark's bundled Hadoop client knows the
# extension setting under a relocated name.
AS_IS = {
    "io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec",
    "io.compress.passthrough.extension": GZIP,
    "org.apache.hadoop.shaded.io.compress.passthrough.extension": GZIP,
}


READERS = ("text", "ranges", "auto")


def is_local(path: str) -> bool:
    return path.startswith("file:") or "://" not in path


def read_ranges(spark: SparkSession, paths: list[str], k: int, format: str | None = None, split_bytes: int | None = None) -> DataFrame:
    """:func:`read_sequences` by the data source of ``sources.datasource``."""
    datasource.register(spark)
    tasks = max(datasource.TASKS, 4 * spark.sparkContext.defaultParallelism)
    load = spark.read.format(datasource.NAME).option("k", k).option("files", json.dumps(paths)).option("tasks", tasks)
    for name, value in (("format", format), ("splitBytes", split_bytes)):
        load = load if value is None else load.option(name, value)
    return load.load()


def read_sequences(
    spark: SparkSession,
    paths: str | list[str],
    k: int,
    format: str | None = None,
    compressed: bool = True,
    reader: str = "text",
) -> DataFrame:
    """``reads(file, seq)`` of all files, as one bag of sequences.

    Each path (a glob may be used) is parsed by its own suffix, unless
    ``format`` names one for all, e.g. for a directory. ``k`` is needed because
    long FASTA records come as tiles that overlap by k-1 bases. Gzip files,
    read by one task each, are scanned apart and their sequences dealt out
    over the cluster; the others stay in their splits. ``compressed=False``
    reads files that merely carry a ``.gz`` name.

    ``reader`` is ``text``, which goes through Spark's text source and so
    reads whatever Spark reads; ``ranges``, the data source of
    ``sources.datasource``, which reads each file once, lines of any length,
    and the members of gzip files in parallel, from local paths and the file
    systems PyArrow has; or ``auto``: ``ranges`` for local paths, else ``text``.
    """
    check_k(k)
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no input files")
    if format is not None and format not in SUFFIXES:
        raise ValueError(f"format must be one of {sorted(SUFFIXES)}")
    if reader not in READERS:
        raise ValueError(f"reader must be one of {READERS}")
    if reader == "ranges" or (reader == "auto" and compressed and all(is_local(p) for p in paths)):
        return read_ranges(spark, paths, k, format)
    options = {} if compressed else AS_IS
    groups: dict[str, list[str]] = {}
    for path in paths:
        groups.setdefault(format or file_format(path), []).append(path)
    parts = []
    for kind, members in groups.items():
        read = partial(read_fasta, k=k) if kind == "fasta" else read_fastq
        for names in (OTHER_NAMES, GZIP_NAMES) if compressed else ("*",):
            own = options | {"pathGlobFilter": names}
            splits = spark.read.options(**own).text(members).rdd.getNumPartitions()
            if splits:
                tasks = tasks_of(spark, splits)
                found = read(spark, members, tasks=tasks if tasks < splits else None, **own)
                parts.append(spread_gzip(found) if names == GZIP_NAMES else spread(found, splits))
    reads = parts[0] if parts else read_fastq(spark, paths, pathGlobFilter="")
    for part in parts[1:]:
        reads = reads.unionByName(part)
    return reads


def union_sources(*reads: DataFrame, seq: str = "seq") -> DataFrame:
    """Bag union of sequence columns; k-mers never span rows or sources."""
    union = reads[0].select(F.col(seq).alias("seq"))
    for part in reads[1:]:
        union = union.unionByName(part.select(F.col(seq).alias("seq")))
    return union
