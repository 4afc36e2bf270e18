import hashlib
import re
from collections import defaultdict

from helpers import document, frame, messy, tuples

from merscope.llm import exact_dedup


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[norm(text)].append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        ids = groups[norm(text)]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups_of_messy_rows(spark):
    rows = messy()
    assert tuples(exact_dedup.exact_groups(frame(spark, rows, clash=True))) == brute(rows)


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "content_hash", lambda text: F.unhex(F.md5(F.lit("same"))))
    rows = [document(i, t) for i, t in enumerate(["a", "b", "a", "c", "b"])]
    assert tuples(exact_dedup.exact_groups(frame(spark, rows))) == brute(rows)


def test_each_document_stays_once_with_its_columns(spark):
    docs = frame(spark, messy(), clash=True)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.select("doc_id", "text").collect()
    texts = [norm(r["text"]) for r in rows]
    assert len(texts) == len(set(texts)) == len({norm(r[1]) for r in messy()})
    assert {1, 3, 6, 7, 8, 9} <= {r["doc_id"] for r in rows}


def test_rows_of_the_document_that_stays(spark, monkeypatch):
    """They are one, also where they differ in white space; beyond the broadcasts too."""
    rows = [document(3, "a b"), document(3, "a  b"), document(3, "a b"), document(4, "a\tb"), document(3, "c"), document(None, "d"), document(None, "d")]
    for most in (exact_dedup.MOST_BROADCAST, 0):
        monkeypatch.setattr(exact_dedup, "MOST_BROADCAST", most)
        kept = exact_dedup.drop_copies(frame(spark, rows, clash=True)).collect()
        assert sorted((str(r["doc_id"]), norm(r["text"])) for r in kept) == [("3", "a b"), ("3", "c"), ("None", "d")]


def test_documents_without_copies_are_not_moved(spark):
    plan = exact_dedup.drop_copies(frame(spark, messy()))._jdf.queryExecution().executedPlan().toString()
    anti = [line for line in plan.splitlines() if "LeftAnti" in line]
    assert anti and all("BroadcastHashJoin" in line for line in anti)


def test_empty_table(spark):
    empty = frame(spark, [])
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
