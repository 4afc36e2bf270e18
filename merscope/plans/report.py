"""The report: a few text lines made from the n+1 histogram rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parameter_line(k: int, n: int, inputs: list[str], output: str, copies: int) -> str:
    # Fixed format: readers of the report rely on it.
    files = "".join(f"{name}, " for name in inputs)
    return f"Parms :  k = {k}; nfreq = {n}; infile(s) = {files}; outfile = {output}; copies = {copies}"


def report_rows(histogram: DataFrame, k: int) -> DataFrame:
    """``(line_no, line)`` of the report below its parameter line."""
    i, est = F.col("i"), F.col("est").cast("string")
    row: Column = F.when(i == 0, F.concat(F.lit("#F0 = "), est)).otherwise(
        F.concat(F.lit("f"), i.cast("string"), F.lit("\t"), est)
    )
    number = F.when(i == 0, F.lit(1)).otherwise(i + 2).cast("bigint")
    header = F.struct(F.lit(2).cast("bigint").alias("line_no"), F.lit(f"f\tk={k}").alias("line"))
    own = F.struct(number.alias("line_no"), row.alias("line"))
    lines = F.when(i == 0, F.array(own, header)).otherwise(F.array(own))
    return histogram.select(F.inline(lines))


def report_text(rows: list[tuple[int, int]], k: int, parameters: str) -> str:
    found = dict(rows)
    lines = [f"#{parameters}", f"#F0 = {found[0]}", f"f\tk={k}"]
    lines += [f"f{i}\t{found[i]}" for i in sorted(found) if i > 0]
    return "\n".join(lines) + "\n"


def write_report(histogram: DataFrame, path: str, k: int, parameters: str) -> list[tuple[int, int]]:
    """Overwrite ``path`` with the report. Brings n+1 rows to the driver."""
    rows = [(r["i"], r["est"]) for r in histogram.select("i", "est").collect()]
    with open(path, "w", encoding="utf-8") as out:
        out.write(report_text(rows, k, parameters))
    return rows
