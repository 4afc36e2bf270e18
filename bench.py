"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS pick the input and the cores. Each query runs once
to warm up and is timed over REPEATS further runs; the best run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from merscope.operators.blocks import blocks_of_reads  # noqa: E402
from merscope.operators.estimate import histogram_from_cells  # noqa: E402
from merscope.operators.exact import distinct_kmers, kmer_counts  # noqa: E402
from merscope.operators.kmers import canonical_kmers  # noqa: E402
from merscope.plans import catalog  # noqa: E402
from merscope.operators.sketch import SketchParams, sketch_cells  # noqa: E402
from merscope.plans.histogram import kmer_cells, kmer_histogram  # noqa: E402
from merscope.session import build_session  # noqa: E402
from merscope.sources.derived import lineitem_reads  # noqa: E402
from merscope.sources.reads import read_sequences  # noqa: E402
from merscope.plans.scratch import scratch_dir  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 2
SEEDS = 10


def queries(spark):
    reads = lineitem_reads(spark, SF_DIR)
    files = {}
    for kind, text in (("fastq", catalog.fastq_text), ("fasta", catalog.fasta_text)):
        files[kind] = scratch_dir(spark)
        text(spark, SF_DIR).write.text(files[kind])

    def from_file(kind, k, reader="text"):
        return kmer_histogram(read_sequences(spark, files[kind], k, format=kind, reader=reader), k, 8, method="exact")

    def in_rows(k):
        """The sketch as one row a cell."""
        return histogram_from_cells(kmer_cells(reads, k), SketchParams(), 8)

    return {
        "exact_k21": lambda: kmer_histogram(reads, 21, 8, method="exact"),
        "exact_k31": lambda: kmer_histogram(reads, 31, 8, method="exact"),
        "exact_k33": lambda: kmer_histogram(reads, 33, 8, method="exact"),
        "sketch_k21": lambda: kmer_histogram(reads, 21, 8),
        "sketch_k31": lambda: kmer_histogram(reads, 31, 8),
        "sketch_k33": lambda: kmer_histogram(reads, 33, 8),
        "sketch_k21_proven": lambda: kmer_histogram(reads, 21, 8, r_exp=12, prove_with=reads.where("crc32(seq) % 8 = 0")),
        "sketch_k11_small": lambda: kmer_histogram(reads, 11, 8, r_exp=12),
        "distinct_k21": lambda: distinct_kmers(canonical_kmers(reads, 21)),
        "fastq_k21": lambda: from_file("fastq", 21),
        "fasta_k21": lambda: from_file("fasta", 21),
        "fastq_ranges_k21": lambda: from_file("fastq", 21, "ranges"),
        "fasta_ranges_k21": lambda: from_file("fasta", 21, "ranges"),
        "sketch_rows_k21": lambda: in_rows(21),
    }


def sent_by_tasks(spark, k, **size):
    """Rows and bytes of the blocks that the tasks send into the shuffle, and how many are marks without cells."""
    blocks = blocks_of_reads(lineitem_reads(spark, SF_DIR), k, SketchParams(**size))
    arrays = sum((F.octet_length(c) for c in ("cols", "low", "high", "cnt")), F.lit(0))
    row = blocks.agg(F.count(F.lit(1)).alias("rows"), F.sum(arrays).alias("bytes"), F.count_if("full").alias("marks")).first()
    return row.asDict()


def main() -> None:
    spark = build_session(
        "merscope-bench",
        master=f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, results = {}, {}
    for name, build in queries(spark).items():
        times = []
        for _ in range(1 + REPEATS):
            began = time.perf_counter()
            results[name] = [tuple(r) for r in build().collect()]
            times.append(time.perf_counter() - began)
        seconds[name] = round(min(times[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    occurrences = {k: canonical_kmers(lineitem_reads(spark, SF_DIR), k).count() for k in (21, 31, 33)}
    errors = {}
    for k in (21, 31, 33):
        exact, sketch = dict(results[f"exact_k{k}"]), dict(results[f"sketch_k{k}"])
        errors[f"k{k}"] = {
            f"f{i}": round(abs(sketch[i] - exact[i]) / exact[i], 4) for i in (0, 1, 2) if exact[i]
        }
    cells = {f"r{r}": kmer_cells(lineitem_reads(spark, SF_DIR), 21, SketchParams(r_exp=r)).count() for r in (12, 19)}
    truth = dict(results["exact_k21"])
    counts = kmer_counts(canonical_kmers(lineitem_reads(spark, SF_DIR), 21)).persist()
    by_seed = []
    for seed in range(SEEDS):
        params = SketchParams(seed=seed)
        found = histogram_from_cells(sketch_cells(counts, params, weight="cnt"), params, 8).collect()
        by_seed.append({r["i"]: abs(r["est"] - truth[r["i"]]) / truth[r["i"]] for r in found if truth[r["i"]]})
    over_seeds = {f"f{i}": round(sum(e[i] for e in by_seed) / SEEDS, 4) for i in by_seed[0]}
    print(
        json.dumps(
            {
                "metric": "k-mer histogram wall time, sum over queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "kmers_per_sec": {
                    f"{m}_k{k}": round(n / seconds[f"{m}_k{k}"])
                    for k, n in occurrences.items()
                    for m in ("exact", "sketch")
                },
                "relative_error": errors,
                "mean_error_over_seeds_k21": over_seeds,
                "cells_k21": cells,
                "sent_k21": {f"r{r}": sent_by_tasks(spark, 21, r_exp=r) for r in (12, 19)},
            }
        )
    )


if __name__ == "__main__":
    main()
