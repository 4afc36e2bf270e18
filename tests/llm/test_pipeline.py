import struct
import zlib

from helpers import document, frame, messy
from test_decontamination import brute as brute_contamination
from test_exact_dedup import norm
from test_ngram_join import brute as brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from merscope.llm import language_id
from merscope.llm.catalog import tokenizer_path

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def expected_pieces(spark, rows, items):
    """What each stage keeps of what the one before it kept, in plain Python."""
    sizer = language_id.Sizer(language_id.learn(frame(spark, rows)))
    rows = [r for r in rows if sizer.identify(r[1])[2]]
    first = {}
    for r in sorted((r for r in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(norm(r[1]), r)
    rows = list(first.values())
    rows = [r for r, (i, _, c) in zip(sorted(rows, key=lambda r: repr((r[0],))), sorted(brute_components(rows), key=lambda x: repr(x[:1]))) if i is None or i == c]
    bad = {r[0] for r in brute_contamination(rows, items) if r[5]}
    rows = [r for r in rows if r[0] not in bad]
    tokenizer, out = Tokenizer.from_file(tokenizer_path()), []
    for r in rows:
        ids = tokenizer.encode(r[1], add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            out.append((r[0], k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return sorted(out, key=repr)


def test_pipeline_against_plain_python(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*DOCUMENTS).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == expected_pieces(spark, rows, items)


def test_stages_take_odd_rows_and_keep_the_columns(spark):
    docs = frame(spark, messy() + [document(50 + i, f"plain words of a text that is number {i} of a few") for i in range(3)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns[0] == "doc_id" and set(docs.columns) == set(DOCUMENTS)
    kept = {r["doc_id"] for r in docs.collect()}
    assert 1 in kept and not {2, 3, 4, 5, 7} & kept


def test_stages_take_an_empty_table(spark):
    empty = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_order_of_the_stages():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "known_language", "without_copies", "without_near_copies", "without_benchmarks", "packed"
    ]
