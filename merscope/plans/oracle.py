"""The catalog's queries in ANSI SQL, for a second engine to run."""

from __future__ import annotations

from functools import partial

from merscope.functions.hashing import multiply_parameters

LINEITEM = """
SELECT translate(md5(l_partkey::VARCHAR) || md5('s' || l_suppkey::VARCHAR),
                 '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq FROM lineitem"""

LINEITEM_KEYED = """
SELECT l_orderkey, translate(md5(l_partkey::VARCHAR) || md5('s' || l_suppkey::VARCHAR),
                 '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq FROM lineitem"""

ORDERS = """
SELECT translate(md5('c' || o_custkey::VARCHAR) || md5('o' || o_orderkey::VARCHAR),
                 '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq FROM orders"""

LONG = """
SELECT translate(md5(l_partkey::VARCHAR) || md5('s' || l_suppkey::VARCHAR)
                 || md5('p' || l_partkey::VARCHAR),
                 '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM lineitem"""

DOCUMENTS = "SELECT translate(text, 'acgt', 'ACGT') AS seq FROM documents"

EVENTS = """
SELECT translate(md5(user_id::VARCHAR) || md5('e' || event_type),
                 '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq FROM events"""


def segments(source: str) -> str:
    return f"""
segs AS (SELECT unnest(regexp_split_to_array(seq, '[^ACGT]+')) AS s FROM ({source}))"""


def kmers(source: str, k: int) -> str:
    """CTE ``kmers(kmer)``: one row per canonical occurrence."""
    return f"""{segments(source)},
wins AS (SELECT substr(s, p, {k}) AS w
         FROM (SELECT s, unnest(range(1, length(s) - {k} + 2)) AS p FROM segs
               WHERE length(s) >= {k})),
kmers AS (SELECT least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM wins)"""


def counts(source: str, k: int) -> str:
    return f"""{kmers(source, k)},
counts AS (SELECT kmer, count(*)::BIGINT AS cnt FROM kmers GROUP BY kmer)"""


def count_rows(source: str, k: int) -> str:
    return f"WITH {counts(source, k)} SELECT kmer, cnt FROM counts"


def histogram_rows(source: str, k: int, n: int) -> str:
    return f"""{counts(source, k)},
histogram AS (
  SELECT i::BIGINT AS i,
         (CASE WHEN i = 0 THEN (SELECT count(*) FROM counts) ELSE coalesce(m, 0) END)::BIGINT AS est
  FROM (SELECT unnest(range(0, {n} + 1)) AS i)
  LEFT JOIN (SELECT cnt, count(*) AS m FROM counts GROUP BY cnt) ON cnt = i)"""


def histogram(source: str, k: int, n: int) -> str:
    return f"WITH {histogram_rows(source, k, n)} SELECT i, est FROM histogram"


def hashes(source: str, k: int, r_exp: int) -> str:
    """CTE ``hashed(copy, level, col, pos, cnt)`` over distinct k-mers."""
    return f"""{counts(source, k)},
digests AS (SELECT copy, cnt, md5(copy::VARCHAR || ':' || kmer) AS m
            FROM counts, (SELECT unnest(range(0, 7))::INTEGER AS copy)),
halves AS (SELECT copy, cnt, ('0x' || substr(m, 1, 15))::BIGINT AS h,
                  ('0x' || substr(m, 17, 8))::BIGINT AS u FROM digests),
hashed AS (SELECT copy, least(63, bit_count(~h & (h - 1)))::INTEGER AS level,
                  (u >> 13) & {(1 << r_exp) - 1} AS col, u & 8191 AS pos, cnt FROM halves)"""


# The five primes of the 64-bit xxHash, and Spark's seed.
PRIMES = (
    11400714785074694791,
    14029467366897019727,
    1609587929392839161,
    9650029242287828579,
    2870177450012600261,
)
SPARK_SEED = 42


def times(a: str, b: int) -> str:
    """Product modulo 2^64 of unsigned numbers."""
    return f"(({a})::UHUGEINT * {b}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"


def rotated(a: str, n: int) -> str:
    high = f"(({a})::UHUGEINT * {1 << n}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"({high} | (({a}) >> {64 - n}))"


def plus(a: str, b: int) -> str:
    return f"((({a})::UHUGEINT + {b}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def xx_step(name: str, source: str, seed: str, value: str, out: str) -> str:
    """CTE ``name``: ``source`` and, as ``out``, the hash of a non-negative
    BIGINT ``value`` chained to ``seed``."""
    p1, p2, p3, p4, p5 = PRIMES
    return f"""
{name}_a AS (SELECT *, {rotated(times(f"({value})::UBIGINT", p2), 31)} AS q_, {plus(seed, (p5 + 8) % 2**64)} AS s_ FROM {source}),
{name}_b AS (SELECT *, xor(s_, {times("q_", p1)}) AS r_ FROM {name}_a),
{name}_c AS (SELECT *, {plus(times(rotated("r_", 27), p1), p4)} AS t_ FROM {name}_b),
{name}_d AS (SELECT *, {times("xor(t_, t_ >> 33)", p2)} AS v_ FROM {name}_c),
{name}_e AS (SELECT *, {times("xor(v_, v_ >> 29)", p3)} AS w_ FROM {name}_d),
{name} AS (SELECT * EXCLUDE (q_, s_, r_, t_, v_, w_), xor(w_, w_ >> 32) AS {out} FROM {name}_e)"""


def packed_word(start: int, stop: int) -> str:
    """Two bits a base of ``kmer`` at ``[start, stop)``, first base highest."""
    return " + ".join(
        f"(instr('ACGT', substr(kmer, {i + 1}, 1)) - 1)::BIGINT * {4 ** (stop - 1 - i)}" for i in range(start, stop)
    )


def xx_first(source: str, k: int, seed: int) -> list[str]:
    """CTEs up to ``halved(copy, cnt, h)``: the 63-bit hash of packed k-mers, word after word."""
    spans = [(a, min(a + 31, k)) for a in range(0, k, 31)]
    words = [f"({packed_word(a, b)})::BIGINT AS word{i}" for i, (a, b) in enumerate(spans)]
    names = ", ".join(f"word{i}" for i in range(len(spans)))
    steps = [
        f"""{counts(source, k)},
packed AS (SELECT {", ".join(words)}, cnt FROM counts),
copied AS (SELECT copy, {names}, cnt FROM packed, (SELECT unnest(range(0, 7))::INTEGER AS copy))""",
        xx_step("seeded", "copied", f"{SPARK_SEED}::UBIGINT", f"({seed * 1_000_003} + copy)", "h0"),
    ]
    before = "seeded"
    for i in range(len(spans)):
        steps.append(xx_step(f"worded{i}", before, f"h{i}", f"word{i}", f"h{i + 1}"))
        before = f"worded{i}"
    return [*steps, f"halved AS (SELECT copy, cnt, h{len(spans)} >> 1 AS h FROM {before})"]


def placed(u: str, r_exp: int, source: str) -> str:
    return f"""hashed AS (
  SELECT copy, least(63, bit_count((~(h::BIGINT)) & (h::BIGINT - 1)))::INTEGER AS level,
         (({u}) >> 13) & {(1 << r_exp) - 1} AS col, ({u}) & 8191 AS pos, cnt
  FROM {source})"""


def xx_hashes(source: str, k: int, r_exp: int, seed: int = 0) -> str:
    """As ``hashes``, with the production hash of packed k-mers."""
    steps = [
        *xx_first(source, k, seed),
        xx_step("again", "halved", f"{SPARK_SEED}::UBIGINT", "h", "g2"),
        xx_step("mixed", "again", "g2", "117", "g3"),
        placed("(g3 >> 32)::BIGINT", r_exp, "mixed"),
    ]
    return ",\n".join(s.strip() for s in steps)


def multiply_hashes(source: str, k: int, r_exp: int, seed: int = 0) -> str:
    """As ``xx_hashes``, with column and fingerprint by an odd multiple and a sum."""
    drawn = [multiply_parameters(copy, seed) for copy in range(7)]
    factor, summand = ("CASE copy " + " ".join(f"WHEN {c} THEN {d[i]}::UHUGEINT" for c, d in enumerate(drawn)) + " END" for i in (0, 1))
    product = f"(h::UHUGEINT * ({factor}) + ({summand})) % 18446744073709551616::UHUGEINT"
    steps = [
        *xx_first(source, k, seed),
        f"mixed AS (SELECT copy, cnt, h, (({product}) // 4294967296::UHUGEINT)::BIGINT AS u FROM halved)",
        placed("u", r_exp, "mixed"),
    ]
    return ",\n".join(s.strip() for s in steps)


def cells(source: str, k: int, r_exp: int, hashed=None) -> str:
    return f"""{(hashed or hashes)(source, k, r_exp)},
cells AS (SELECT copy, level, col, min(pos)::BIGINT AS pos_min, max(pos)::BIGINT AS pos_max,
                 sum(cnt)::BIGINT AS cnt FROM hashed GROUP BY copy, level, col),
vals AS (SELECT copy, level, CASE WHEN pos_min = pos_max AND cnt < 65535 THEN cnt END AS v
         FROM cells)"""


def marked_cells(source: str, k: int, r_exp: int, hashed) -> str:
    """Cells, with a mark in place of those of a level whose columns all are invalid."""
    return f"""WITH {cells(source, k, r_exp, hashed)},
filled AS (SELECT copy, level, count(*) FILTER (pos_min < pos_max) = {1 << r_exp} AS is_full FROM cells GROUP BY copy, level)
SELECT cells.* FROM cells JOIN filled USING (copy, level) WHERE NOT is_full
UNION ALL SELECT copy, level, -1, 0, 1, 0 FROM filled WHERE is_full"""


def levels(source: str, k: int, r_exp: int, n: int, hashed=None) -> str:
    return f"""{cells(source, k, r_exp, hashed)},
levels AS (
  SELECT copy, level, 0::BIGINT AS v, ({1 << r_exp} - count(*))::BIGINT AS t
  FROM vals GROUP BY copy, level
  UNION ALL
  SELECT copy, level, v, count(*)::BIGINT FROM vals WHERE v <= {n} GROUP BY copy, level, v)"""


def picks(source: str, k: int, r_exp: int, n: int, hashed=None) -> str:
    half = 1 << (r_exp - 1)
    return f"""{levels(source, k, r_exp, n, hashed)},
picks AS (
  SELECT * FROM (SELECT copy, v, level, t FROM levels WHERE v = 0 AND abs(t - {half}) < {half}
                 QUALIFY row_number() OVER (PARTITION BY copy ORDER BY abs(t - {half}), level) = 1)
  UNION ALL
  SELECT * FROM (SELECT copy, v, level, t FROM levels WHERE v > 0
                 QUALIFY row_number() OVER (PARTITION BY copy, v ORDER BY t DESC, level) = 1))"""


def estimates(source: str, k: int, r_exp: int, n: int, hashed=None) -> str:
    r = f"{1 << r_exp}.0::DOUBLE"
    return f"""{picks(source, k, r_exp, n, hashed)},
copies AS (SELECT unnest(range(0, 7))::INTEGER AS copy),
f0 AS (SELECT copy, ceil(pow(2.0::DOUBLE, level + 1) * ln(t / ({r})) / ln(1 - 1 / ({r})))::BIGINT AS est
       FROM picks WHERE v = 0),
mid AS (SELECT list_sort(list(coalesce(est, 0)))[4] AS f0 FROM copies LEFT JOIN f0 USING (copy)),
ests AS (
  SELECT copy, 0::BIGINT AS i, est FROM f0
  UNION ALL
  SELECT copy, v, ceil(pow(2.0::DOUBLE, level + 1) * ({r} - 1) * (t / ({r}))
                       / pow(1 - 1 / ({r}), f0 / pow(2.0::DOUBLE, level + 1)))::BIGINT
  FROM picks, mid WHERE v > 0)"""


def sketch_histogram(source: str, k: int, r_exp: int, n: int, hashed=None) -> str:
    return f"""WITH {estimates(source, k, r_exp, n, hashed)}
SELECT i::BIGINT AS i, list_sort(list(coalesce(est, 0)))[4]::BIGINT AS est
FROM (SELECT unnest(range(0, {n} + 1)) AS i) CROSS JOIN copies
LEFT JOIN ests USING (copy, i) GROUP BY i"""


def symbol_counts() -> str:
    classes = {
        "A": "[Aa]", "C": "[Cc]", "G": "[Gg]", "T": "[Tt]", "N": "[Nn]",
        "CR": r"\r", "NL": r"\n", "PLUS": r"\+", "AT": "@", "GT": ">",
    }
    parts = [
        f"SELECT '{name}' AS symbol, sum(length(text) - length(regexp_replace(text, '{p}', '', 'g')))::BIGINT AS cnt FROM documents"
        for name, p in classes.items()
    ]
    known = " UNION ALL ".join(parts)
    return f"""WITH known AS ({known})
SELECT symbol, cnt FROM known UNION ALL
SELECT 'OTHER', (SELECT sum(strlen(text)) FROM documents)::BIGINT - sum(cnt)::BIGINT FROM known"""


def line_reads(number: int) -> str:
    return f"{LINEITEM} WHERE l_linenumber = {number}"


def grouped(names: dict[str, str], k: int, r_exp: int, n: int) -> str:
    """Histograms of several sources, each by its name."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS grp, i, est FROM ({sketch_histogram(source, k, r_exp, n, xx_hashes)})" for name, source in names.items()
    )


def build() -> dict[str, str]:
    k, r, n = 11, 12, 8
    runs = "SELECT s AS segment, count(*)::BIGINT AS cnt FROM segs"
    code = "+".join(f"(instr('ACGT', substr(kmer, {i}, 1)) - 1) * {4 ** (11 - i)}" for i in range(1, 12))
    both = f"{LINEITEM} UNION ALL {ORDERS}"
    small_sketch = sketch_histogram(LINEITEM, k, r, n)
    seeded = partial(xx_hashes, seed=5)
    return {
        "base_class_counts": symbol_counts(),
        "segments_split": f"WITH {segments(LINEITEM)} {runs} WHERE s <> '' GROUP BY s",
        "segments_of_text": f"WITH {segments(DOCUMENTS)} {runs} WHERE length(s) >= 2 GROUP BY s",
        "reverse_complement": f"""WITH {segments(LINEITEM)}
            SELECT DISTINCT s AS segment, reverse(translate(s, 'ACGT', 'TGCA')) AS rc
            FROM segs WHERE length(s) >= 8""",
        "canonical_segment": f"""WITH {segments(LINEITEM)}
            SELECT least(s, reverse(translate(s, 'ACGT', 'TGCA'))) AS canonical,
                   count(*)::BIGINT AS cnt
            FROM segs WHERE length(s) >= 8 GROUP BY 1""",
        "two_bit_encode": f"""WITH {counts(LINEITEM, k)}
            SELECT kmer, ({code})::BIGINT AS code, kmer AS back FROM counts""",
        "kmers_extract": count_rows(LINEITEM, 5),
        "canonical_kmer": f"""WITH {counts(LINEITEM, 4)}
            SELECT kmer, kmer = reverse(translate(kmer, 'ACGT', 'TGCA')) AS palindrome, cnt
            FROM counts""",
        "packed_code": f"WITH {counts(LINEITEM, k)} SELECT ({code})::BIGINT AS kmer, cnt FROM counts",
        "case_folding": count_rows(LINEITEM, 7),
        "kmer_counts_k11": count_rows(LINEITEM, 11),
        "kmer_counts_k31": count_rows(LINEITEM, 31),
        "kmer_counts_k32": count_rows(LINEITEM, 32),
        "kmer_counts_k33": count_rows(LINEITEM, 33),
        "kmer_counts_k65": f"""WITH {counts(LONG, 65)}
            SELECT substr(kmer, 1, 5) AS prefix, count(*)::BIGINT AS kmers, sum(cnt)::BIGINT AS cnt,
                   min(kmer) AS first_kmer, max(kmer) AS last_kmer
            FROM counts GROUP BY 1""",
        "kmer_strings_k33": count_rows(LINEITEM, 33),
        "long_sequence_tiling": count_rows(DOCUMENTS, 3),
        "kmer_histogram_exact": histogram(LINEITEM, 21, 8),
        "kmer_histogram_exact_k33": histogram(LINEITEM, 33, 8),
        "kmer_histogram_exact_n1000": histogram(LINEITEM, 11, 1000),
        "distinct_kmers": f"WITH {kmers(LINEITEM, 21)} SELECT count(DISTINCT kmer)::BIGINT AS f0 FROM kmers",
        "multi_source_union": histogram(both, 15, 8),
        "report_lines": f"""WITH {histogram_rows(LINEITEM, 15, 10)}
            SELECT 1::BIGINT AS line_no, '#F0 = ' || est::VARCHAR AS line FROM histogram WHERE i = 0
            UNION ALL SELECT 2, 'f' || chr(9) || 'k=15'
            UNION ALL SELECT i + 2, 'f' || i::VARCHAR || chr(9) || est::VARCHAR FROM histogram WHERE i > 0""",
        "level_hash": f"""WITH {hashes(LINEITEM, k, r)}
            SELECT copy, level, count(*)::BIGINT AS cnt FROM hashed GROUP BY copy, level""",
        "col_pos_hash": f"""WITH {hashes(LINEITEM, k, r)}
            SELECT copy, level, sum(col)::BIGINT AS sum_col, max(col)::BIGINT AS max_col,
                   sum(pos)::BIGINT AS sum_pos, max(pos)::BIGINT AS max_pos,
                   sum(col * pos)::BIGINT AS sum_product
            FROM hashed GROUP BY copy, level""",
        "sketch_cells": f"WITH {cells(LINEITEM, k, r)} SELECT * FROM cells",
        "sketch_cells_by_occurrence": f"WITH {cells(LINEITEM, 21, r)} SELECT * FROM cells",
        "sketch_cells_merged": f"WITH {cells(both, k, r)} SELECT * FROM cells",
        "sketch_cell_values": f"""WITH {cells(LINEITEM, k, r)}
            SELECT copy, level, count(*)::BIGINT AS occupied, count(v)::BIGINT AS valid,
                   sum(v)::BIGINT AS hits
            FROM vals GROUP BY copy, level""",
        "sketch_level_histogram": f"WITH {levels(LINEITEM, k, r, n)} SELECT copy, level, v, t FROM levels",
        "sketch_best_level_f0": f"""WITH {picks(LINEITEM, k, r, n)}
            SELECT copy, level, t FROM picks WHERE v = 0""",
        "sketch_best_level_fj": f"""WITH {picks(LINEITEM, k, r, n)}
            SELECT copy, v, level, t FROM picks WHERE v > 0""",
        "sketch_f0_estimate": f"WITH {estimates(LINEITEM, k, r, n)} SELECT copy, est FROM ests WHERE i = 0",
        "sketch_fj_estimate": f"WITH {estimates(LINEITEM, k, r, n)} SELECT copy, i, est FROM ests WHERE i > 0",
        "kmer_histogram_sketch": small_sketch,
        "kmer_histogram_sketch_n1000": sketch_histogram(LINEITEM, k, r, 1000),
        "sketch_level_pruning": sketch_histogram(LINEITEM, k, 6, n),
        "sketch_saved": small_sketch,
        "sketch_merged_unequal_sizes": sketch_histogram(both, k, 6, n),
        "sketch_saturation": f"""WITH {cells(LINEITEM, 2, 8)}
            SELECT copy, level, count(*)::BIGINT AS occupied,
                   count(*) FILTER (pos_min = pos_max AND cnt >= 65535)::BIGINT AS saturated,
                   count(v)::BIGINT AS valid, coalesce(sum(v), 0)::BIGINT AS hits, max(cnt)::BIGINT AS most
            FROM cells JOIN (SELECT copy, level, col, CASE WHEN pos_min = pos_max AND cnt < 65535 THEN cnt END AS v
                             FROM cells) USING (copy, level, col)
            GROUP BY copy, level""",
        "level_hash_xx": f"""WITH {xx_hashes(LINEITEM, k, r)}
            SELECT copy, level, count(*)::BIGINT AS cnt FROM hashed GROUP BY copy, level""",
        "sketch_cells_xx": f"WITH {cells(LINEITEM, k, r, seeded)} SELECT * FROM cells",
        "sketch_cells_xx_k33": f"WITH {cells(LINEITEM, 33, r, xx_hashes)} SELECT * FROM cells",
        "sketch_blocks": marked_cells(LINEITEM, k, r, seeded),
        "sketch_blocks_k33": marked_cells(LINEITEM, 33, r, xx_hashes),
        "sketch_blocks_marked": sketch_histogram(LINEITEM, k, 6, n, xx_hashes),
        "sketch_cells_multiply": f"WITH {cells(LINEITEM, k, r, multiply_hashes)} SELECT * FROM cells",
        "sketch_blocks_multiply": marked_cells(LINEITEM, k, r, partial(multiply_hashes, seed=9)),
        "grouped_histogram": grouped({str(i): line_reads(i) for i in range(1, 8)}, k, r, n),
        "grouped_rollup": grouped({"early": f"{LINEITEM} WHERE l_linenumber < 4", "late": f"{LINEITEM} WHERE l_linenumber >= 4"}, k, r, n),
        "sql_kmers": f"""WITH {kmers(LINEITEM, k)}
            SELECT reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc, kmer, count(*)::BIGINT AS cnt FROM kmers GROUP BY kmer""",
        "fastq_ranges": f"SELECT seq, count(*)::BIGINT AS cnt FROM ({LINEITEM}) GROUP BY seq",
        "fasta_ranges": count_rows(LINEITEM, 11),
        "fastq_gzip_ranges": histogram(LINEITEM, 21, 8),
        "stream_state_histogram": sketch_histogram(EVENTS, k, r, n, xx_hashes),
        "stream_state_files": sketch_histogram(LINEITEM, k, r, n, xx_hashes),
        "kmer_histogram_sketch_xx": sketch_histogram(LINEITEM, 21, 19, n, xx_hashes),
        "fastq_read": f"SELECT seq, count(*)::BIGINT AS cnt FROM ({LINEITEM}) GROUP BY seq",
        "fastq_gzip_histogram": histogram(LINEITEM, 21, 8),
        "fasta_read": count_rows(LINEITEM, 11),
        "fasta_gzip_histogram": histogram(LINEITEM, 21, 8),
        "fasta_split_borders": count_rows(LINEITEM, 11),
        "file_suffix_mixed": f"""WITH sources AS (
                SELECT seq, 'fastq' AS kind, l_orderkey % 3 = 0 AS gz FROM ({LINEITEM_KEYED})
                UNION ALL SELECT seq, 'fasta', l_orderkey % 3 = 1 FROM ({LINEITEM_KEYED})),
            {kmers("SELECT seq FROM sources", 11)}
            SELECT kmer, count(*)::BIGINT AS cnt FROM kmers GROUP BY kmer""",
        "stream_histogram": sketch_histogram(EVENTS, k, r, n),
    }


ORACLE_SQL = build()
