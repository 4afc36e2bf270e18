import hashlib
import random

import pytest
from helpers import document, frame, messy, tuples, words

from merscope.llm import decontamination

ITEMS = "item_id bigint, text string"


def brute(rows, items, span=13):
    wins = set()
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - span, 0) + 1):
            if w:
                wins.add((None if item is None else str(item), tuple(w[s : s + span])))
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for item, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found.add(item)
        ids = sorted(found - {None})
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def digests(docs, items):
    return tuples(decontamination.contamination(docs, items).drop("text_hash", "hits"))


def make(rng, letters, n):
    return " ".join(rng.choice(letters) for _ in range(n))


@pytest.fixture(scope="module")
def case():
    rng = random.Random(7)
    items = [(i, make(rng, "abcdefg", rng.randint(0, 40))) for i in range(12)]
    items += [(12, "TIE, tie"), (13, "tie tie"), (13, "tie tie"), (14, None), (15, "..."), (None, "lazy dog near")]
    rows = messy()
    for i in range(100, 130):
        item = rng.choice(items)[1] or ""
        rows.append(document(i, f"{make(rng, 'abcdefg', rng.randint(0, 30))} {item.upper()} {make(rng, 'xyz', rng.randint(0, 400))}"))
    return rows, items


def test_against_brute_force(spark, case):
    rows, items = case
    assert digests(frame(spark, rows, clash=True), spark.createDataFrame(items, ITEMS)) == brute(rows, items)


def test_many_blocks_give_the_same(spark, case, monkeypatch):
    rows, items = case
    monkeypatch.setattr(decontamination, "BLOCK", 40)
    assert digests(frame(spark, rows), spark.createDataFrame(items, ITEMS)) == brute(rows, items)


def test_empty_tables(spark, case):
    rows, items = case
    bench = spark.createDataFrame(items, ITEMS)
    assert digests(frame(spark, []), bench) == []
    assert digests(frame(spark, rows), spark.createDataFrame([], ITEMS)) == brute(rows, [])


def test_documents_removed_and_spans_cut(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], ITEMS)
    dirty = "Start, One two three four five six seven eight nine ten eleven twelve Thirteen; end."
    rows = [document(1, dirty), document(2, "clean text"), document(None, dirty), document(3, None)]
    docs = frame(spark, rows, clash=True)
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in decontamination.cut_spans(docs, items).collect()}
    assert cut[1] == "Start, end." and cut[2] == "clean text" and cut[3] is None


def test_joins_beyond_the_broadcasts_give_the_same(spark, case, monkeypatch):
    rows, items = case
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", 0)
    bench = spark.createDataFrame(items, ITEMS)
    assert digests(frame(spark, rows, clash=True), bench) == brute(rows, items)
    clean = sorted((r[0] for r in brute(rows, items) if not r[5]), key=repr)
    kept = decontamination.drop_contaminated(frame(spark, rows), bench).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == clean


def test_spans_that_overlap_or_lie_apart(spark):
    """The words outside all hits stay, in order, with what stands between them."""
    rng = random.Random(11)
    items = [(i, make(rng, "abcdefg", n)) for i, n in enumerate([13, 15, 3, 4, 20])]
    rows = []
    for i in range(40):
        parts = [rng.choice([make(rng, "xyz", rng.randint(0, 4)), rng.choice(items)[1], make(rng, "abcdefg", 2)]) for _ in range(6)]
        rows.append(document(i, ", ".join(parts) + "."))
    wins = {tuple(words(t)[s : s + 13]) for _, t in items for s in range(max(len(words(t)) - 13, 0) + 1)}
    cut = {r["doc_id"]: r["text"] for r in decontamination.cut_spans(frame(spark, rows), spark.createDataFrame(items, ITEMS)).collect()}
    for doc_id, text, *_ in rows:
        w = words(text)
        hit = {p for win in wins for s in range(len(w) - len(win) + 1) if tuple(w[s : s + len(win)]) == win for p in range(s, s + len(win))}
        assert words(cut[doc_id]) == [x for p, x in enumerate(w) if p not in hit]
        assert hit or cut[doc_id] == text


def test_a_window_of_many_items(spark):
    """Items that share a window are all told, though no window's row carries them."""
    head = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = [(i, f"{head} own{i}") for i in range(300)]
    rows = [document(1, head), document(2, f"{head} own7"), document(3, "none of it")]
    assert digests(frame(spark, rows), spark.createDataFrame(items, ITEMS)) == brute(rows, items)


def test_a_text_of_a_million_words(spark):
    """Windows are looked up as hashes; a row a window that held the text's words would not end."""
    text = " ".join(f"w{i % 9973}" for i in range(1_000_000))
    head = " ".join(f"w{i}" for i in range(13))
    (row,) = decontamination.contamination(frame(spark, [document(1, text)]), spark.createDataFrame([(5, head)], ITEMS)).collect()
    hits = -(-(1_000_000 - 12) // 9973)
    assert (row["n_words"], row["n_hit"], row["n_items"], row["contaminated"]) == (1_000_000, 13 * hits, 1, False)
