import zlib
from collections import Counter

import pytest
from helpers import document, frame, messy
from pyspark.sql import functions as F

from merscope.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 17, 100, 257])
def test_permutation_is_one_to_one(spark, n):
    rows = spark.range(n).select(sharding.permuted(F.col("id"), F.lit(n).cast("long"), 17).alias("place"))
    assert sorted(r["place"] for r in rows.collect()) == list(range(n))


def test_shuffle_is_seeded_and_moves_rows(spark):
    def order(seed):
        rows = spark.range(500).select("id", sharding.permuted(F.col("id"), F.lit(500).cast("long"), seed).alias("p"))
        return [r["p"] for r in rows.orderBy("id").collect()]

    assert order(1) == order(1) != order(2)
    assert sum(i == p for i, p in enumerate(order(1))) < 20


def check(found, rows):
    sizes = Counter(r["shard"] for r in found)
    counts = [sizes[s] for s in range(8)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    for shard in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sizes[shard]))


def test_messy_documents(spark):
    rows = messy()
    found = sharding.document_shards(frame(spark, rows, clash=True)).collect()
    check(found, rows)
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=repr) == want
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in found)


def test_input_partitions_do_not_matter(spark):
    docs = frame(spark, [document(i, f"text {i % 7}") for i in range(200)])
    one = sharding.document_shards(docs.coalesce(1)).collect()
    many = sharding.document_shards(docs.repartition(9)).collect()
    assert sorted(one) == sorted(many)


def test_empty_table(spark):
    assert sharding.document_shards(frame(spark, [])).count() == 0
