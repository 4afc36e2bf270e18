"""What a run has read, counted by the run itself."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from merscope.functions.bases import BASES


class RunCounts:
    """Counts taken along with the reads of one histogram; there is no second pass.

    They are there once the run has ended. ``symbols`` and ``bases`` are those
    of the rows handed on: tiles of a long sequence overlap by k-1. Reads that
    are read twice on purpose (``prove_with``) count once.
    """

    def __init__(self) -> None:
        self.observation = Observation()
        self.began = time.time()

    def watch(self, reads: DataFrame, seq: str = "seq") -> DataFrame:
        """The same reads, counted as they pass."""
        text = F.col(seq)
        symbols = F.length(text)
        others = F.length(F.translate(text, BASES + BASES.lower(), ""))
        none = F.lit(0).cast("bigint")
        return reads.observe(
            self.observation,
            F.count(text).alias("sequences"),
            F.coalesce(F.sum(symbols.cast("bigint")), none).alias("symbols"),
            F.coalesce(F.sum((symbols - others).cast("bigint")), none).alias("bases"),
        )

    def get(self) -> dict[str, int]:
        return dict(self.observation.get)

    def summary(self) -> str:
        found, seconds = self.get(), max(time.time() - self.began, 1e-9)
        broken = found["symbols"] - found["bases"]
        return (
            f"read: {found['sequences']} sequences, {found['bases']} bases, {broken} other symbols, "
            f"{found['symbols'] / seconds / 1e6:.2f} M symbols/s"
        )
