"""From sketch cells to the abundance histogram.

Everything here works on per-level counts, whose number depends on copies,
levels and n but not on the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merscope.operators.exact import check_n
from merscope.operators.sketch import MARK, SATURATED, SketchParams, cell_value


def check_frequencies(n: int) -> int:
    if check_n(n) >= SATURATED:
        raise ValueError(f"n must be below {SATURATED}: larger counts are not kept in a cell")
    return n


def level_histogram(cells: DataFrame, params: SketchParams, n: int) -> DataFrame:
    """``(copy, level, v, t)``: t cells of the level hold value v, for v in
    1..n; v = 0 counts the empty columns. Invalid cells and values above n
    appear in no row but do occupy their column. A level marked full has no
    empty column and no value.

    The values are bucketed before grouping, so a single pass over the cells
    gives both the occupancy and the value counts.
    """
    check_frequencies(n)
    value = cell_value()
    bucket = F.when(value <= n, value).otherwise(F.lit(0).cast("bigint"))
    counts = cells.groupBy("copy", "level", bucket.alias("v")).agg(
        F.count(F.lit(1)).alias("t"), F.max(F.col("col") == MARK).alias("full")
    )
    valued = F.filter(F.col("parts"), lambda p: p["v"] > 0)
    empty = F.struct(
        F.lit(0).cast("bigint").alias("v"), (F.lit(params.columns) - F.col("occupied")).alias("t")
    )
    none_empty = F.array(F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(0).cast("bigint").alias("t")))
    rows = F.when(F.col("full"), none_empty).otherwise(F.concat(F.array(empty), valued))
    return (
        counts.groupBy("copy", "level")
        .agg(
            F.sum("t").alias("occupied"),
            F.collect_list(F.struct("v", "t")).alias("parts"),
            F.max("full").alias("full"),
        )
        .select("copy", "level", F.inline(rows))
    )


def best_levels(level_hist: DataFrame, params: SketchParams, by: tuple[str, ...] = ()) -> DataFrame:
    """``(copy, v, level, t)``: the level each estimate is read from, for each value of ``by``.

    v = 0: the level whose empty columns come closest to R/2, leaving out
    levels that are completely full or completely empty. v >= 1: the level with
    most cells of value v. Ties go to the lowest level; a copy with no usable
    level for v has no row.
    """
    half = params.columns // 2
    distance = F.abs(F.col("t") - F.lit(half))
    usable = (F.col("v") == 0) & (distance < half)
    near = F.min(F.when(usable, F.struct(distance.alias("d"), F.col("level"), F.col("t"))))
    most = F.max(F.when(F.col("v") > 0, F.struct(F.col("t"), (-F.col("level")).alias("up"))))
    picked = level_hist.groupBy(*by, "copy", "v").agg(near.alias("near"), most.alias("most"))
    return picked.select(
        *by,
        "copy",
        "v",
        F.coalesce(F.col("near.level"), -F.col("most.up")).alias("level"),
        F.coalesce(F.col("near.t"), F.col("most.t")).alias("t"),
    ).where(F.col("level").isNotNull())


def f0_estimate(t: Column, level: Column, params: SketchParams) -> Column:
    """Distinct k-mers, from t empty columns on a level."""
    r = float(params.columns)
    scale = F.pow(F.lit(2.0), level + F.lit(1))
    return F.ceil(scale * F.ln(t / F.lit(r)) / F.lit(math.log(1 - 1 / r)))


def fj_estimate(t: Column, level: Column, f0: Column, params: SketchParams) -> Column:
    """Distinct k-mers of one multiplicity, from t cells of that value.

    NULL where no column of the level is expected to be left alone, or the
    result is beyond a BIGINT: nothing can be read from such a level.
    """
    r = float(params.columns)
    scale = F.pow(F.lit(2.0), level + F.lit(1))
    untouched = F.pow(F.lit(1 - 1 / r), f0 / scale)
    found = scale * F.lit(r - 1) * (t / F.lit(r)) / F.nullif(untouched, F.lit(0.0))
    return F.ceil(F.when(found < 2.0**63, found))


def middle(estimates: Column, copies: int) -> Column:
    """Median over all copies; a copy without an estimate counts as 0."""
    missing = F.array_repeat(F.lit(0).cast("bigint"), F.lit(copies) - F.size(estimates))
    return F.element_at(F.sort_array(F.concat(estimates, missing)), copies // 2 + 1)


def estimates_per_copy(picks: DataFrame, params: SketchParams, by: tuple[str, ...] = ()) -> DataFrame:
    """``(copy, i, est)``, for each value of ``by``; the f_i use the median F0 of all copies.

    The window sees at most copies * (n+1) rows a value.
    """
    own_f0 = F.when(F.col("v") == 0, f0_estimate(F.col("t"), F.col("level"), params))
    f0 = middle(F.collect_list(own_f0).over(Window.partitionBy(*by)), params.copies)
    rows = (picks if by else picks.coalesce(1)).withColumn("f0", f0)
    fj = fj_estimate(F.col("t"), F.col("level"), F.col("f0"), params)
    return rows.select(*by, "copy", F.col("v").alias("i"), F.coalesce(own_f0, fj).alias("est"))


def histogram_from_cells(cells: DataFrame, params: SketchParams, n: int) -> DataFrame:
    """``histogram(i, est)`` with exactly the rows i = 0..n, zeros included."""
    return histogram_from_levels(level_histogram(cells, params, n), params, n)


def histogram_from_levels(level_hist: DataFrame, params: SketchParams, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The same from the ``(copy, level, v, t)`` of any form of the sketch.

    With ``by``, for each of its values that has any k-mer.
    """
    rows = estimates_per_copy(best_levels(level_hist, params, by), params, by).select(*by, "i", "est")
    none = F.lit(None).cast("bigint").alias("est")
    if by:
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n).cast("bigint")))
        grid = level_hist.select(*by).distinct().select(*by, every.alias("i"), none)
        union = rows.unionByName(grid)
    else:
        grid = level_hist.sparkSession.range(n + 1).select(F.col("id").alias("i"), none)
        union = rows.unionByName(grid).coalesce(1)
    return union.groupBy(*by, "i").agg(middle(F.collect_list("est"), params.copies).alias("est"))
