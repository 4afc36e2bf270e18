"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merscope.functions import bases
from merscope.functions.sql import register_sql
from merscope.operators import blocks, estimate, exact, grouped, sketch
from merscope.operators.kmers import canonical_kmer_strings, counted_kmers
from merscope.operators.segments import segments
from merscope.operators.sketch import SketchParams
from merscope.plans.histogram import kmer_blocks, kmer_cells, kmer_histogram
from merscope.plans.report import report_rows
from merscope.plans.scratch import scratch_dir
from merscope.sources import derived
from merscope.sources.reads import read_ranges, read_sequences, union_sources
from merscope.streaming.sketch_stream import start_sketch_stream, stream_cells
from merscope.streaming.state_stream import start_file_state_stream, start_state_stream, state_histogram

Query = Callable[[SparkSession, str], DataFrame]

# The md5 family lets another engine recompute each cell; its small R lets
# several levels compete at the test scale.
SMALL = SketchParams(r_exp=12, hash="md5")
SMALL_K = 11
SMALL_N = 8
CROWDED = SketchParams(r_exp=6, hash="md5")

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def read_strings(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return canonical_kmer_strings(derived.lineitem_reads(spark, sf_dir), k)


def distinct_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct k-mers of the line items, of which alone strings are made."""
    packed = counted_kmers(derived.lineitem_reads(spark, sf_dir), SMALL_K)
    return packed.select(bases.decode_words(SMALL_K).alias("kmer"))


def counted(reads: DataFrame, k: int) -> DataFrame:
    """``(kmer, cnt)`` with the packed k-mers spelled out."""
    counts = counted_kmers(reads, k)
    return counts.select(bases.decode_words(k).alias("kmer"), "cnt")


def small_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = derived.lineitem_reads(spark, sf_dir)
    return kmer_cells(reads, SMALL_K, SMALL, preaggregate=True)


def small_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.level_histogram(small_cells(spark, sf_dir), SMALL, SMALL_N)


# --- symbols, segments, scalar functions ------------------------------------


@query
def base_class_counts(spark, sf_dir):
    counts = bases.symbol_class_counts(F.col("seq"))
    pairs = [F.struct(F.lit(s).alias("symbol"), F.col(s).alias("cnt")) for s in counts]
    wide = derived.document_texts(spark, sf_dir).agg(*[c.alias(s) for s, c in counts.items()])
    return wide.select(F.inline(F.array(*pairs)))


@query
def segments_split(spark, sf_dir):
    runs = segments(derived.lineitem_reads(spark, sf_dir))
    return runs.groupBy("segment").agg(F.count(F.lit(1)).alias("cnt"))


@query
def segments_of_text(spark, sf_dir):
    runs = segments(derived.document_texts(spark, sf_dir), 2)
    return runs.groupBy("segment").agg(F.count(F.lit(1)).alias("cnt"))


@query
def reverse_complement(spark, sf_dir):
    runs = segments(derived.lineitem_reads(spark, sf_dir), 8).distinct()
    return runs.select("segment", bases.reverse_complement(F.col("segment")).alias("rc"))


@query
def canonical_segment(spark, sf_dir):
    runs = segments(derived.lineitem_reads(spark, sf_dir), 8)
    smaller = bases.canonical(F.col("segment"))
    return runs.groupBy(smaller.alias("canonical")).agg(F.count(F.lit(1)).alias("cnt"))


@query
def two_bit_encode(spark, sf_dir):
    kmers = distinct_strings(spark, sf_dir)
    code = bases.encode_2bit(F.col("kmer"))
    return kmers.select("kmer", code.alias("code"), bases.decode_2bit(code, SMALL_K).alias("back"))


# --- k-mers ------------------------------------------------------------------


@query
def kmers_extract(spark, sf_dir):
    return counted(derived.lineitem_reads(spark, sf_dir), 5)


@query
def canonical_kmer(spark, sf_dir):
    """k = 4, where some k-mers are their own reverse complement."""
    counts = counted(derived.lineitem_reads(spark, sf_dir), 4)
    own = F.col("kmer") == bases.reverse_complement(F.col("kmer"))
    return counts.select("kmer", own.alias("palindrome"), "cnt")


@query
def packed_code(spark, sf_dir):
    """The packed column itself."""
    return counted_kmers(derived.lineitem_reads(spark, sf_dir), SMALL_K)


@query
def case_folding(spark, sf_dir):
    reads = derived.lineitem_reads(spark, sf_dir).select(F.lower("seq").alias("seq"))
    return counted(reads, 7)


@query
def kmer_counts_k11(spark, sf_dir):
    return counted(derived.lineitem_reads(spark, sf_dir), 11)


@query
def kmer_counts_k31(spark, sf_dir):
    return counted(derived.lineitem_reads(spark, sf_dir), 31)


@query
def kmer_counts_k32(spark, sf_dir):
    return counted(derived.lineitem_reads(spark, sf_dir), 32)


@query
def kmer_counts_k33(spark, sf_dir):
    return counted(derived.lineitem_reads(spark, sf_dir), 33)


@query
def kmer_counts_k65(spark, sf_dir):
    """Three-word k-mers, summed up per leading bases."""
    ends = exact.ends_by_prefix(counted_kmers(derived.long_reads(spark, sf_dir), 65), 65, 5)
    return ends.groupBy("prefix").agg(
        F.sum("kmers").alias("kmers"),
        F.sum("cnt").alias("cnt"),
        F.min("first_kmer").alias("first_kmer"),
        F.max("last_kmer").alias("last_kmer"),
    )


@query
def kmer_strings_k33(spark, sf_dir):
    return exact.kmer_counts(read_strings(spark, sf_dir, 33))


@query
def long_sequence_tiling(spark, sf_dir):
    return counted(derived.document_texts(spark, sf_dir), 3)


# --- exact histogram ----------------------------------------------------------


@query
def kmer_histogram_exact(spark, sf_dir):
    return kmer_histogram(derived.lineitem_reads(spark, sf_dir), 21, 8, method="exact")


@query
def kmer_histogram_exact_k33(spark, sf_dir):
    return kmer_histogram(derived.lineitem_reads(spark, sf_dir), 33, 8, method="exact")


@query
def kmer_histogram_exact_n1000(spark, sf_dir):
    return kmer_histogram(derived.lineitem_reads(spark, sf_dir), 11, 1000, method="exact")


@query
def distinct_kmers(spark, sf_dir):
    return counted_kmers(derived.lineitem_reads(spark, sf_dir), 21).agg(F.count(F.lit(1)).alias("f0"))


@query
def multi_source_union(spark, sf_dir):
    reads = union_sources(
        derived.lineitem_reads(spark, sf_dir), derived.orders_reads(spark, sf_dir)
    )
    return kmer_histogram(reads, 15, 8, method="exact")


@query
def report_lines(spark, sf_dir):
    histogram = kmer_histogram(derived.lineitem_reads(spark, sf_dir), 15, 10, method="exact")
    return report_rows(histogram, 15)


# --- sketch -------------------------------------------------------------------


@query
def level_hash(spark, sf_dir):
    """k-mers per copy and sampling level."""
    kmers = distinct_strings(spark, sf_dir)
    rows = sketch.hashed_kmers(kmers, SMALL)
    return rows.groupBy("copy", "level").agg(F.count(F.lit(1)).alias("cnt"))


@query
def col_pos_hash(spark, sf_dir):
    """Columns and fingerprints per copy and level."""
    kmers = distinct_strings(spark, sf_dir)
    rows = sketch.hashed_kmers(kmers, SMALL)
    return rows.groupBy("copy", "level").agg(
        F.sum("col").alias("sum_col"),
        F.max("col").alias("max_col"),
        F.sum("pos").alias("sum_pos"),
        F.max("pos").alias("max_pos"),
        F.sum(F.col("col") * F.col("pos")).alias("sum_product"),
    )


@query
def sketch_cells(spark, sf_dir):
    return small_cells(spark, sf_dir)


@query
def sketch_cells_by_occurrence(spark, sf_dir):
    """Cells fed one occurrence at a time instead of from counts."""
    return kmer_cells(derived.lineitem_reads(spark, sf_dir), 21, SMALL)


@query
def sketch_cells_merged(spark, sf_dir):
    """Two sketches of two sources, merged."""
    orders = kmer_cells(derived.orders_reads(spark, sf_dir), SMALL_K, SMALL)
    return sketch.merge_cells(small_cells(spark, sf_dir), orders)


@query
def sketch_cell_values(spark, sf_dir):
    """Valid, invalid and hit totals per level."""
    value = estimate.cell_value()
    return small_cells(spark, sf_dir).groupBy("copy", "level").agg(
        F.count(F.lit(1)).alias("occupied"),
        F.count(value).alias("valid"),
        F.sum(value).alias("hits"),
    )


@query
def sketch_level_histogram(spark, sf_dir):
    return small_levels(spark, sf_dir)


@query
def sketch_best_level_f0(spark, sf_dir):
    picks = estimate.best_levels(small_levels(spark, sf_dir), SMALL)
    return picks.where("v = 0").select("copy", "level", "t")


@query
def sketch_best_level_fj(spark, sf_dir):
    return estimate.best_levels(small_levels(spark, sf_dir), SMALL).where("v > 0")


@query
def sketch_f0_estimate(spark, sf_dir):
    picks = estimate.best_levels(small_levels(spark, sf_dir), SMALL)
    return estimate.estimates_per_copy(picks, SMALL).where("i = 0").select("copy", "est")


@query
def sketch_fj_estimate(spark, sf_dir):
    picks = estimate.best_levels(small_levels(spark, sf_dir), SMALL)
    return estimate.estimates_per_copy(picks, SMALL).where("i > 0")


@query
def kmer_histogram_sketch(spark, sf_dir):
    return estimate.histogram_from_cells(small_cells(spark, sf_dir), SMALL, SMALL_N)


@query
def kmer_histogram_sketch_n1000(spark, sf_dir):
    return estimate.histogram_from_cells(small_cells(spark, sf_dir), SMALL, 1000)


@query
def sketch_level_pruning(spark, sf_dir):
    """A sketch that leaves out levels proven full reports what all levels do."""
    reads = derived.lineitem_reads(spark, sf_dir)
    part = reads.where(F.crc32("seq") % 2 == 0)
    cells = kmer_cells(reads, SMALL_K, CROWDED, prove_with=part, preaggregate=True)
    return estimate.histogram_from_cells(cells, CROWDED, SMALL_N)


@query
def sketch_merged_unequal_sizes(spark, sf_dir):
    """A large input with levels left out, merged with a small one with all."""
    large = derived.lineitem_reads(spark, sf_dir)
    cells = kmer_cells(large, SMALL_K, CROWDED, prove_with=large, preaggregate=True)
    small = kmer_cells(derived.orders_reads(spark, sf_dir), SMALL_K, CROWDED)
    return estimate.histogram_from_cells(sketch.merge_cells(cells, small), CROWDED, SMALL_N)


@query
def sketch_saturation(spark, sf_dir):
    """2-mers, of which there are so few that cells reach the largest count."""
    params = SketchParams(r_exp=8, hash="md5")
    cells = kmer_cells(derived.lineitem_reads(spark, sf_dir), 2, params, preaggregate=True)
    value = estimate.cell_value()
    alone = F.col("pos_min") == F.col("pos_max")
    return cells.groupBy("copy", "level").agg(
        F.count(F.lit(1)).alias("occupied"),
        F.count_if(alone & (F.col("cnt") >= sketch.SATURATED)).alias("saturated"),
        F.count(value).alias("valid"),
        F.coalesce(F.sum(value), F.lit(0)).alias("hits"),
        F.max("cnt").alias("most"),
    )


@query
def level_hash_xx(spark, sf_dir):
    """As ``level_hash``, with the production hash."""
    kmers = counted_kmers(derived.lineitem_reads(spark, sf_dir), SMALL_K).select("kmer")
    rows = sketch.hashed_kmers(kmers, SketchParams(r_exp=12))
    return rows.groupBy("copy", "level").agg(F.count(F.lit(1)).alias("cnt"))


@query
def sketch_cells_xx(spark, sf_dir):
    """Cells of the production hash with a seed."""
    params = SketchParams(r_exp=12, seed=5)
    return kmer_cells(derived.lineitem_reads(spark, sf_dir), SMALL_K, params, preaggregate=True)


@query
def sketch_saved(spark, sf_dir):
    """A sketch written, read back and estimated."""
    path = scratch_dir(spark)
    sketch.save_sketch(small_cells(spark, sf_dir), path, SMALL_K, SMALL)
    cells, _, params = sketch.load_sketch(spark, path)
    return estimate.histogram_from_cells(cells, params, SMALL_N)


@query
def kmer_histogram_sketch_xx(spark, sf_dir):
    """Production hash and size."""
    return kmer_histogram(derived.lineitem_reads(spark, sf_dir), 21, 8)


# --- files and streams ----------------------------------------------------------


def numbered_reads(spark, sf_dir, where=None):
    rows = derived.table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    rows = rows if where is None else rows.where(where)
    seq = derived.bases_of(derived.digest("", "l_partkey"), derived.digest("s", "l_suppkey"))
    name = F.concat_ws("/", "l_orderkey", "l_linenumber")
    return rows.select(name.alias("name"), seq.alias("seq"))


def fastq_text(spark, sf_dir, where=None):
    """Records whose quality lines often begin with ``@`` or ``+``."""
    quality = F.translate(F.reverse("seq"), "ACGTN", "@+IA#")
    record = F.concat_ws("\n", F.concat(F.lit("@r"), "name"), "seq", F.lit("+"), quality)
    return numbered_reads(spark, sf_dir, where).select(record)


def fasta_text(spark, sf_dir, where=None):
    """Records wrapped at 24 bases; some headers hold a second ``>``."""
    wrapped = F.regexp_replace("seq", "(.{24})", "$1\n")
    return numbered_reads(spark, sf_dir, where).select(
        F.concat_ws("\n", F.concat(F.lit(">r"), "name", F.lit(" from>to")), wrapped)
    )


@query
def fastq_read(spark, sf_dir):
    path = scratch_dir(spark)
    fastq_text(spark, sf_dir).write.text(path)
    reads = read_sequences(spark, path, 21, format="fastq")
    return reads.groupBy("seq").agg(F.count(F.lit(1)).alias("cnt"))


@query
def fastq_gzip_histogram(spark, sf_dir):
    path = scratch_dir(spark)
    fastq_text(spark, sf_dir).write.text(path, compression="gzip")
    return kmer_histogram(
        read_sequences(spark, path, 21, format="fastq"), 21, 8, method="exact"
    )


@query
def fasta_read(spark, sf_dir):
    path = scratch_dir(spark)
    fasta_text(spark, sf_dir).write.text(path)
    return counted(read_sequences(spark, path, 11, format="fasta"), 11)


@query
def fasta_gzip_histogram(spark, sf_dir):
    path = scratch_dir(spark)
    fasta_text(spark, sf_dir).write.text(path, compression="gzip")
    return kmer_histogram(
        read_sequences(spark, path, 21, format="fasta"), 21, 8, method="exact"
    )


@contextmanager
def small_file_splits(spark, size):
    """Input splits of ``size`` bytes for the plans made inside."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in zip(names, (size, 0)):
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@query
def fasta_split_borders(spark, sf_dir):
    """FASTA files cut into many input splits, so that k-mers cross borders."""
    path = scratch_dir(spark)
    fasta_text(spark, sf_dir).write.text(path)
    with small_file_splits(spark, 1 << 18):
        counts = counted(read_sequences(spark, path, 11, format="fasta"), 11)
        kept = scratch_dir(spark)
        counts.write.parquet(kept)
    return spark.read.parquet(kept)


@query
def file_suffix_mixed(spark, sf_dir):
    """FASTA and FASTQ, plain and gzip, in one call, told apart by suffix."""
    path = scratch_dir(spark)
    paths = []
    for kind, text, rest in (("fastq", fastq_text, 0), ("fasta", fasta_text, 1)):
        for gz in (True, False):
            part = F.col("l_orderkey") % 3 == rest
            rows = text(spark, sf_dir, part if gz else ~part)
            paths.append(f"{path}/reads.{kind}" + ".gz" * gz)
            rows.write.text(paths[-1], compression="gzip" if gz else "none")
    return counted(read_sequences(spark, paths, 11), 11)


@query
def stream_histogram(spark, sf_dir):
    """The events table as a stream of files, sketched batch by batch."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    inbox = scratch_dir(spark)
    files = max(4, table.rdd.getNumPartitions())
    table.repartition(files, "event_id").write.parquet(inbox)
    events = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files // 4).parquet(inbox)
    work = scratch_dir(spark)
    stream = start_sketch_stream(
        derived.event_reads(events),
        f"{work}/state",
        f"{work}/progress",
        SMALL_K,
        SMALL,
        preaggregate=True,
    )
    stream.awaitTermination()
    return estimate.histogram_from_cells(stream_cells(spark, f"{work}/state"), SMALL, SMALL_N)


# --- blocks, groups, SQL --------------------------------------------------------------


@query
def sketch_cells_xx_k33(spark, sf_dir):
    """Cells of k-mers of two words."""
    return kmer_cells(derived.lineitem_reads(spark, sf_dir), 33, SketchParams(r_exp=12), preaggregate=True)


@query
def sketch_blocks(spark, sf_dir):
    """The cells of ``sketch_cells_xx``, combined in the tasks and moved in blocks."""
    params = SketchParams(r_exp=12, seed=5)
    return blocks.cells_of_blocks(kmer_blocks(derived.lineitem_reads(spark, sf_dir), SMALL_K, params), params)


@query
def sketch_blocks_k33(spark, sf_dir):
    params = SketchParams(r_exp=12)
    found = kmer_blocks(derived.lineitem_reads(spark, sf_dir), 33, params, preaggregate=True)
    return blocks.cells_of_blocks(found, params)


@query
def sketch_blocks_marked(spark, sf_dir):
    """A sketch so small that most of its blocks are marked full on the way."""
    params = SketchParams(r_exp=6)
    found = kmer_blocks(derived.lineitem_reads(spark, sf_dir), SMALL_K, params)
    return estimate.histogram_from_levels(blocks.block_level_histogram(found, params, SMALL_N), params, SMALL_N)


@query
def sketch_cells_multiply(spark, sf_dir):
    """Cells of the two-universal hash."""
    params = SketchParams(r_exp=12, hash="multiply")
    return kmer_cells(derived.lineitem_reads(spark, sf_dir), SMALL_K, params, preaggregate=True)


@query
def sketch_blocks_multiply(spark, sf_dir):
    """The same in blocks, with another seed."""
    params = SketchParams(r_exp=12, hash="multiply", seed=9)
    return blocks.cells_of_blocks(kmer_blocks(derived.lineitem_reads(spark, sf_dir), SMALL_K, params), params)


def line_blocks(spark: SparkSession, sf_dir: str, params: SketchParams) -> DataFrame:
    """A sketch for each line number of the line items."""
    rows = derived.table(spark, sf_dir, "lineitem", "l_linenumber", "l_partkey", "l_suppkey")
    seq = derived.bases_of(derived.digest("", "l_partkey"), derived.digest("s", "l_suppkey"))
    return grouped.grouped_blocks(rows.select("l_linenumber", seq.alias("seq")), F.col("l_linenumber"), SMALL_K, params)


@query
def grouped_histogram(spark, sf_dir):
    params = SketchParams(r_exp=12)
    return grouped.grouped_histogram(line_blocks(spark, sf_dir, params), params, SMALL_N)


@query
def grouped_rollup(spark, sf_dir):
    """Two coarser groups, from the sketches of the finer ones."""
    params = SketchParams(r_exp=12)
    half = F.when(F.col("grp").cast("int") < 4, "early").otherwise("late")
    return grouped.grouped_histogram(grouped.rolled_up(line_blocks(spark, sf_dir, params), half, params), params, SMALL_N)


@query
def sql_kmers(spark, sf_dir):
    """k-mer counts as a SQL text."""
    register_sql(spark)
    return spark.sql(
        """SELECT reverse_complement(kmer) AS rc, kmer, count(*) AS cnt
        FROM (SELECT kmer FROM {reads}, LATERAL kmers(seq, {k})) GROUP BY kmer""",
        reads=derived.lineitem_reads(spark, sf_dir),
        k=SMALL_K,
    )


# --- files by ranges, keyed stream state ----------------------------------------------


@query
def fastq_ranges(spark, sf_dir):
    """FASTQ through the data source, in ranges far shorter than the files."""
    path = scratch_dir(spark)
    fastq_text(spark, sf_dir).write.text(path)
    reads = read_ranges(spark, [path], 21, "fastq", split_bytes=1 << 18)
    return reads.groupBy("seq").agg(F.count(F.lit(1)).alias("cnt"))


@query
def fasta_ranges(spark, sf_dir):
    """FASTA through the data source, with k-mers across the borders of its ranges."""
    path = scratch_dir(spark)
    fasta_text(spark, sf_dir).write.text(path)
    return counted(read_ranges(spark, [path], 11, "fasta", split_bytes=1 << 16), 11)


@query
def fastq_gzip_ranges(spark, sf_dir):
    """Gzip files through the data source, in ranges of which some hold no member's beginning."""
    path = scratch_dir(spark)
    fastq_text(spark, sf_dir).write.text(path, compression="gzip")
    return kmer_histogram(read_ranges(spark, [path], 21, "fastq", split_bytes=1 << 16), 21, 8, method="exact")


@query
def stream_state_histogram(spark, sf_dir):
    """The events table as a stream of files, sketched in the state store."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    inbox, folder = scratch_dir(spark), scratch_dir(spark)
    files = max(4, table.rdd.getNumPartitions())
    table.repartition(files, "event_id").write.parquet(inbox)
    events = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files // 4).parquet(inbox)
    params = SketchParams(r_exp=12)
    start_state_stream(derived.event_reads(events), folder, SMALL_K, params).awaitTermination()
    return state_histogram(spark, folder, params, SMALL_N)


@query
def stream_state_files(spark, sf_dir):
    """FASTA files as a stream, read in ranges as they come."""
    inbox, folder = scratch_dir(spark), scratch_dir(spark)
    fasta_text(spark, sf_dir).write.text(inbox)
    params = SketchParams(r_exp=12)
    start_file_state_stream(
        spark, inbox, "fasta", folder, SMALL_K, params, files_per_batch=3, split_bytes=1 << 18
    ).awaitTermination()
    return state_histogram(spark, folder, params, SMALL_N)
