"""The operators for users of SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from merscope.functions.bases import BASES, COMPLEMENTS, NON_BASES

SCALARS = {
    "normalised": f"translate(s, '{BASES.lower()}', '{BASES}')",
    "reverse_complement": f"reverse(translate(s, '{BASES}', '{COMPLEMENTS}'))",
    "canonical": f"least(s, reverse(translate(s, '{BASES}', '{COMPLEMENTS}')))",
}


# Each run of bases and its reverse complement as bytes, of which a window is cut without a walk from the start. The
# parts are handed on as lambda variables, so that each is made once.
RUNS = f"""transform(filter(split(translate(s, '{BASES.lower()}', '{BASES}'), '{NON_BASES}'), run -> length(run) >= k),
  run -> struct(CAST(run AS BINARY) AS there, CAST(reverse(translate(run, '{BASES}', '{COMPLEMENTS}')) AS BINARY) AS back))"""
WINDOWS = f"""flatten(transform({RUNS}, run -> transform(sequence(1, length(run.there) - k + 1),
  at -> CAST(least(substring(run.there, at, k), substring(run.back, length(run.there) - at - k + 2, k)) AS STRING))))"""
# One generator over the arguments alone: Catalyst puts that in place of a lateral join, without a shuffle.
KMERS = f"""SELECT explode(CASE WHEN k >= 1 THEN {WINDOWS}
  ELSE raise_error('k must be a positive integer, got ' || coalesce(CAST(k AS STRING), 'NULL')) END) AS kmer"""


def register_sql(spark: SparkSession) -> None:
    """Make ``kmers(seq, k)`` and the functions of ``SCALARS`` known to the session.

    ``kmers`` is a table function for ``LATERAL``: a row for each k-mer
    occurrence of a sequence, none of a null; it stays in the task that has
    the sequence. All are SQL functions, which Catalyst puts in place.
    """
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION kmers(s STRING, k INT) RETURNS TABLE(kmer STRING) RETURN {KMERS}")
    for name, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS STRING RETURN {body}")
