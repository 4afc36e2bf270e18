"""FASTQ: four-line records, read from splittable text in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_START = "\n@"


def fastq_sequences(raw: DataFrame, value: str = "value") -> DataFrame:
    """``(file, seq)`` from text cut at every line that begins with ``@``.

    Such a piece is either a record (header, bases, ``+`` line, quality) or,
    since a quality may begin with ``@`` too, what is left of a quality line. A
    piece with a second line holds bases; the rest of a quality line has none.
    ``+name`` lines and CRLF need no special case, and a last record may end
    right after its bases. Records whose bases span several lines are refused.
    """
    # Cut first, decide after: the steps are kept apart so that Spark does not
    # repeat the cutting in every condition.
    cut = raw.select(
        "file",
        F.substring_index(value, "\n", 2).alias("two"),
        F.substring_index(value, "\n", 3).alias("three"),
        F.octet_length(value).alias("size"),
    )
    two, rest = F.col("two"), F.col("size") - F.octet_length("two")
    bases = F.rtrim(F.substring_index(two, "\n", -1), F.lit("\r"))
    third = F.substring(F.col("three").cast("binary"), F.octet_length("two") + F.lit(2), F.lit(1))
    message = F.concat(F.lit("FASTQ record without a '+' line after its bases in "), F.col("file"))
    one_line = ~F.contains(two, F.lit("\n"))
    none = F.array().cast("array<string>")
    found = (
        F.when(one_line, none)
        .when(third == F.lit(b"+"), F.array(bases))
        .when(bases == "", none)
        .when(rest <= 1, F.array(bases))
        .otherwise(F.array(F.raise_error(message).cast("string")))
    )
    return cut.select("file", F.explode(found).alias("seq"))


def read_fastq(spark: SparkSession, paths: list[str], tasks: int | None = None, **options) -> DataFrame:
    """``reads(file, seq)`` of FASTQ files; header and quality are dropped. ``tasks`` as in ``read_fasta``."""
    raw = spark.read.options(**options).text(paths, lineSep=RECORD_START)
    named = raw.select("value", F.col("_metadata.file_path").alias("file"))
    return fastq_sequences(named.coalesce(tasks) if tasks else named)
