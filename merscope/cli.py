"""Command line: ``python -m merscope -k 15 -f 10 -o out.txt -i reads.fq``."""

from __future__ import annotations

import argparse
import sys
import threading
import time
from contextlib import contextmanager

from pyspark.errors import AnalysisException

from merscope.functions.hashing import MAX_LEVEL
from merscope.plans.histogram import METHODS, kmer_histogram_from_files
from merscope.plans.report import parameter_line, write_report
from merscope.plans.telemetry import RunCounts
from merscope.session import build_session
from merscope.sources.reads import READERS

USAGE = (
    "Usage: python -m merscope -k LENGTH -f FREQUENCIES -o REPORT -i FILE [FILE ...]\n"
    "FILE is FASTA (.fa, .fasta) or FASTQ (.fq, .fastq), each also with .gz; -h lists all options."
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="merscope", description="k-mer abundance histogram")
    p.add_argument("-k", type=int, default=21, help="k-mer length")
    p.add_argument("-f", type=int, default=8, help="number of frequencies f_1..f_n")
    p.add_argument("-o", default="out", help="report file, overwritten")
    p.add_argument("-i", nargs="+", default=[], help="FASTA/FASTQ files, plain or gzip")
    p.add_argument("--method", choices=METHODS, default="sketch")
    p.add_argument("--r-exp", type=int, default=19, help="log2 of the columns per level")
    p.add_argument("--copies", type=int, default=7, help="independent sketch copies (odd)")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--prove-files", type=int, default=0, help="leading files to prove full sketch levels with")
    p.add_argument("--reader", choices=READERS, default="text", help="how files are read: see read_sequences")
    p.add_argument("--master", default=None, help="Spark master, if not set elsewhere")
    return p


@contextmanager
def progress(spark, every: float = 10.0):
    """Print how far the running stages are, every so many seconds."""
    ended = threading.Event()
    tracker = spark.sparkContext.statusTracker()

    def watch() -> None:
        while not ended.wait(every):
            for stage in tracker.getActiveStageIds():
                if info := tracker.getStageInfo(stage):
                    print(f"stage {stage}: {info.numCompletedTasks} of {info.numTasks} tasks done", file=sys.stderr, flush=True)

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    finally:
        ended.set()
        watcher.join()


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv:
        print(USAGE)
        return 0
    args, unknown = parser().parse_known_args(argv)
    if unknown:
        print(f"ignored: {' '.join(unknown)}", file=sys.stderr)
    if not args.i:
        print("no input files: give them with -i", file=sys.stderr)
        return 1
    if args.k < 1:
        print("-k must be at least 1", file=sys.stderr)
        return 1
    parameters = parameter_line(args.k, args.f, args.i, args.o, args.copies)
    print(parameters)
    spark = build_session(master=args.master)
    began = time.time()
    print(time.ctime(began))
    for name in args.i:
        print(f"input: {name}", flush=True)
    counts = RunCounts()
    try:
        histogram = kmer_histogram_from_files(
            spark,
            args.i,
            args.k,
            args.f,
            method=args.method,
            r_exp=args.r_exp,
            copies=args.copies,
            seed=args.seed,
            reader=args.reader,
            counts=counts,
            **({"prove_files": args.prove_files} if args.prove_files else {}),
        )
    except (ValueError, AnalysisException) as error:
        print(error, file=sys.stderr)
        return 1
    with progress(spark):
        write_report(histogram, args.o, args.k, parameters)
    ended = time.time()
    print(time.ctime(ended))
    print(f"finished after {ended - began:.0f} s")
    print(counts.summary())
    if args.method == "sketch":
        cells = (MAX_LEVEL + 1) * args.copies << args.r_exp
        print(f"Sketch : at most {cells} cells over all executors")
    print(f"report written to {args.o}")
    return 0
