"""k-mer abundance histograms as Spark jobs.

The package turns sequencing reads (FASTA/FASTQ files or any DataFrame with a
sequence column) into canonical k-mers and reports how many distinct k-mers
there are (F0) and how many occur exactly 1..n times (f_1..f_n), either
exactly or through a bounded, mergeable sketch.
"""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from merscope.plans.histogram import kmer_histogram, kmer_histogram_from_files  # noqa: E402
from merscope.sources.reads import read_sequences  # noqa: E402

__all__ = ["kmer_histogram", "kmer_histogram_from_files", "read_sequences"]
