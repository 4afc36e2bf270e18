"""The k-mer sketch: several independent copies of sampled hash cells.

Every k-mer hashes, per copy, to a level (level w with chance 2^-(w+1)), one of
R columns and a fingerprint below U. A cell stands for one (copy, level,
column). What the estimators need of a cell is whether all of its hits had one
fingerprint, and how many hits there were; the triple (smallest fingerprint,
largest fingerprint, hits) says both, and merging two triples is min, max and
sum. So the sketch is an ordinary grouped aggregate: combined map-side, merged
in the shuffle, spillable, and independent of the order of the input.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merscope.functions.hashing import HASH_FAMILIES, MAX_LEVEL, column_of, fingerprint_of, level_of
from merscope.operators.segments import check_k

CELL_COLUMNS = ["copy", "level", "col", "pos_min", "pos_max", "cnt"]
CELL_SCHEMA = "copy int, level int, col bigint, pos_min bigint, pos_max bigint, cnt bigint"

# Fixed value: a cell hit this often or more counts as invalid, as a 16-bit
# counter would have saturated.
SATURATED = 65535

# Column number of the row that marks a whole level as full: see full_levels.
MARK = -1


@dataclass(frozen=True)
class SketchParams:
    """Size and seed of a sketch. Sketches merge only if all of it is equal."""

    r_exp: int = 19
    u_exp: int = 13
    copies: int = 7
    seed: int = 0
    hash: str = "xxhash64"

    def __post_init__(self):
        if self.copies < 1 or self.copies % 2 == 0:
            raise ValueError("copies must be odd, so that a middle estimate exists")
        if self.r_exp < 1 or self.u_exp < 1 or self.r_exp + self.u_exp > 32:
            raise ValueError("r_exp and u_exp must be positive and sum to at most 32")
        if self.hash not in HASH_FAMILIES:
            raise ValueError(f"hash must be one of {sorted(HASH_FAMILIES)}")

    @property
    def columns(self) -> int:
        return 1 << self.r_exp


def hashed_kmers(
    kmers: DataFrame,
    params: SketchParams,
    skip: list[tuple[int, int]] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """``(copy, level, col, pos[, weight])`` for every k-mer and copy, but for
    the pairs ``(copy, level)`` in ``skip``."""
    words = [c for c in kmers.columns if c != weight]
    keep = [weight] if weight else []
    by_copy: dict[int, list[int]] = {}
    for copy, level in skip or []:
        by_copy.setdefault(copy, []).append(level)
    rows = HASH_FAMILIES[params.hash](kmers, words, params.copies, params.seed, by_copy, keep)
    return rows.select(
        "copy",
        level_of(F.col("h")).alias("level"),
        column_of(F.col("u"), params.r_exp, params.u_exp).alias("col"),
        fingerprint_of(F.col("u"), params.u_exp).alias("pos"),
        *keep,
    )


def sketch_cells(
    kmers: DataFrame,
    params: SketchParams = SketchParams(),
    full: list[tuple[int, int]] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Occupied cells of the sketch of ``kmers``.

    ``kmers`` holds one row per occurrence, or distinct k-mers with their
    counts in the column ``weight``. Copy, level and column are grouped as one
    packed BIGINT, which keeps the aggregation buffers small. The pairs
    ``(copy, level)`` in ``full`` get a mark in place of their cells.
    """
    level_bits = MAX_LEVEL.bit_length()
    r_exp = params.r_exp
    hits = F.sum(weight) if weight else F.count(F.lit(1))
    copy_level = F.shiftleft(F.col("copy").cast("bigint"), level_bits).bitwiseOR(F.col("level").cast("bigint"))
    packed = F.shiftleft(copy_level, r_exp).bitwiseOR(F.col("col"))
    cells = (
        hashed_kmers(kmers, params, full, weight)
        .groupBy(packed.alias("cell"))
        .agg(F.min("pos").alias("pos_min"), F.max("pos").alias("pos_max"), hits.alias("cnt"))
    )
    cell = F.col("cell")
    unpacked = cells.select(
        F.shiftright(cell, r_exp + level_bits).cast("int").alias("copy"),
        F.shiftright(cell, r_exp).bitwiseAND(F.lit(MAX_LEVEL)).cast("int").alias("level"),
        cell.bitwiseAND(F.lit(params.columns - 1)).alias("col"),
        "pos_min",
        "pos_max",
        "cnt",
    )
    return unpacked.unionByName(marks(kmers.sparkSession, full)) if full else unpacked


def marks(spark: SparkSession, full: list[tuple[int, int]]) -> DataFrame:
    """A row for each full level: an invalid cell in the column ``MARK``."""
    return spark.createDataFrame([(copy, level, MARK, 0, 1, 0) for copy, level in full], CELL_SCHEMA)


def full_levels(cells: DataFrame, params: SketchParams) -> list[tuple[int, int]]:
    """The pairs ``(copy, level)`` whose columns are all invalid.

    A cell hit by two fingerprints stays invalid whatever is added, so a level
    that is full in the sketch of a part is full in that of the whole: nothing
    is empty or valid there and no estimate can be read from it. That is
    counted, not estimated. At most copies * (MAX_LEVEL + 1) pairs.
    """
    marked = F.max(F.col("col") == MARK)
    invalid = F.count_if((F.col("col") != MARK) & (F.col("pos_min") < F.col("pos_max")))
    found = cells.groupBy("copy", "level").agg(marked.alias("marked"), invalid.alias("invalid"))
    return [(r["copy"], r["level"]) for r in found.where(F.col("marked") | (F.col("invalid") == params.columns)).collect()]


def merge_cells(*parts: DataFrame) -> DataFrame:
    """Sketch of the bag union of the inputs of ``parts``.

    A level that is marked full in any part is full in the union; its mark
    is kept and stands above any cells of the level.
    """
    union = parts[0].select(*CELL_COLUMNS)
    for part in parts[1:]:
        union = union.unionByName(part.select(*CELL_COLUMNS))
    return union.groupBy("copy", "level", "col").agg(
        F.min("pos_min").alias("pos_min"),
        F.max("pos_max").alias("pos_max"),
        F.sum("cnt").alias("cnt"),
    )


def cell_value(cnt: str = "cnt") -> Column:
    """Hits of a valid cell; NULL where fingerprints differ or hits saturate."""
    valid = (F.col("pos_min") == F.col("pos_max")) & (F.col(cnt) < SATURATED)
    return F.when(valid, F.col(cnt))


def save_sketch(cells: DataFrame, path: str, k: int, params: SketchParams) -> None:
    """Write a sketch below ``path``; the newest one written counts.

    Cells go to a folder of their own. The row that names it, with the
    parameters, is added last, so a failure in between leaves what was there.
    """
    spark = cells.sparkSession
    check_k(k)
    version = uuid.uuid4().hex
    cells.select(*CELL_COLUMNS).write.parquet(f"{path}/cells/{version}")
    named = spark.createDataFrame([{"k": k, **asdict(params), "version": version}]).withColumn("saved", F.current_timestamp())
    named.coalesce(1).write.mode("append").json(f"{path}/params")


def load_sketch(spark: SparkSession, path: str) -> tuple[DataFrame, int, SketchParams]:
    """Cells, k and parameters of the newest sketch saved below ``path``."""
    schema = "k int, r_exp int, u_exp int, copies int, seed bigint, hash string, version string, saved timestamp"
    newest = spark.read.schema(schema).json(f"{path}/params").orderBy(F.desc("saved")).first()
    if newest is None:
        raise ValueError(f"no finished sketch in {path}")
    saved = newest.asDict()
    k, version, _ = saved.pop("k"), saved.pop("version"), saved.pop("saved")
    return spark.read.schema(CELL_SCHEMA).parquet(f"{path}/cells/{version}"), k, SketchParams(**saved)
