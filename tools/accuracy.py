"""Relative error of the sketch over several seeds, against exact counts.

    python tools/accuracy.py [SF_DIR] [K] [SEEDS]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from merscope.operators.estimate import histogram_from_cells  # noqa: E402
from merscope.operators.exact import abundance_histogram, kmer_counts  # noqa: E402
from merscope.operators.kmers import canonical_kmers  # noqa: E402
from merscope.operators.sketch import SketchParams, sketch_cells  # noqa: E402
from merscope.plans.scratch import scratch_dir  # noqa: E402
from merscope.session import build_session  # noqa: E402
from merscope.sources.derived import lineitem_reads  # noqa: E402

N = 8


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    k = int(sys.argv[2]) if len(sys.argv) > 2 else 21
    seeds = int(sys.argv[3]) if len(sys.argv) > 3 else 10
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    path = scratch_dir(spark)
    kmer_counts(canonical_kmers(lineitem_reads(spark, sf_dir), k)).write.parquet(path)
    counts = spark.read.parquet(path)
    exact = {r["i"]: r["est"] for r in abundance_histogram(counts, N).collect()}
    print("exact", exact)
    for r_exp in (14, 16, 19):
        errors = {i: [] for i in exact}
        for seed in range(seeds):
            params = SketchParams(r_exp=r_exp, seed=seed)
            cells = sketch_cells(counts, params, weight="cnt")
            for r in histogram_from_cells(cells, params, N).collect():
                if exact[r["i"]]:
                    errors[r["i"]].append(abs(r["est"] - exact[r["i"]]) / exact[r["i"]])
        row = " ".join(
            f"f{i} {sum(e) / len(e):.4f}/{max(e):.4f}" for i, e in errors.items() if e
        )
        print(f"R=2^{r_exp} mean/max over {seeds} seeds: {row}", flush=True)


if __name__ == "__main__":
    main()
