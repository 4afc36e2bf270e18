import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from helpers import LOW, document, frame, messy, tuples

from merscope.llm import components, ngram_join, shingles as shingle_module
from merscope.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if a is not None and b is not None and s and t and 100 * len(s & t) >= 85 * len(s | t):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=repr)


def edited(rng, words, share):
    out = list(words)
    for _ in range(round(len(words) * share)):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    """Chains and groups of near copies of all sizes, shared passages, short texts."""
    rng = random.Random(3)
    rows, passage = messy(), [f"shared{i}" for i in range(40)]
    for base in range(14):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 20, 60, 200]))]
        for _ in range(rng.choice([1, 4, 12])):
            rows.append(document(len(rows) + 100, " ".join(words)))
            words = edited(rng, words, rng.choice([0, 0.01, 0.03, 0.06]))
    for _ in range(40):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([2, 5, 8, 60]))]
        rows.append(document(len(rows) + 100, " ".join(own + passage)))
    return rows


def test_against_brute_force(spark, corpus):
    assert tuples(ngram_join.near_duplicate_components(frame(spark, corpus, clash=True))) == brute(corpus)


def test_hot_shingles_lose_no_link(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 3)
    assert tuples(ngram_join.near_duplicate_components(frame(spark, corpus))) == brute(corpus)


def test_texts_of_one_template_meet_in_no_list(spark, monkeypatch):
    """Pages of a template with too many own words to link: the work stays linear, and nothing is linked."""
    monkeypatch.setattr(ngram_join, "HOT", 3)
    rng = random.Random(6)
    template = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(60):
        own = [f"o{rng.randrange(10**9)}" for _ in range(24)]
        rows.append(document(i, " ".join(template[:100] + own + template[100:])))
    docs = frame(spark, rows + [document(99, rows[5][1] + " end")])
    found = ngram_join.near_duplicate_components(docs)
    assert tuples(found) == brute(rows + [document(99, rows[5][1] + " end")])
    ids = docs.select("doc_id").distinct()
    entries = ngram_join.dense_entries(docs, ids)
    assert entries.where("indexed").select("token").distinct().count() == entries.select("token").distinct().count() < 60


def test_shuffled_verification_gives_the_same(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_BROADCAST", 0)
    assert tuples(ngram_join.near_duplicate_components(frame(spark, corpus[:60]))) == brute(corpus[:60])


def test_prefixes_share_as_many_as_the_level_asks(spark):
    """The lemma the filter rests on, on sets right at the threshold."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        both = rng.integers(0, 2**40, rng.integers(1, 300), np.uint64)
        more = rng.integers(2**40, 2**41, max(1, len(both) // 6), np.uint64)
        a = np.unique(np.concatenate([both, more[: len(more) // 2]]) * np.uint64(0x9E3779B97F4A7C15))
        b = np.unique(np.concatenate([both, more[len(more) // 2 :]]) * np.uint64(0x9E3779B97F4A7C15))
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 85 * (len(a) + len(b) - shared):
            continue
        for level in range(1, min(int(ngram_join.highest_level(len(x))) for x in (a, b)) + 1):
            heads = [x[: ngram_join.prefix(len(x), level)] for x in (a, b)]
            assert len(np.intersect1d(*heads)) >= level
            assert all(ngram_join.prefix(len(x), level) <= ngram_join.head_length(len(x)) for x in (a, b))
        assert ngram_join.possible(len(a), len(b), *(x[: int(ngram_join.head_length(len(x)))].view(np.int64) for x in (a, b)))


def test_levels_skip_hot_shingles():
    plain = ngram_join.choose_levels(400, np.array([0, 5]), np.array([2, 2]))
    hot = ngram_join.choose_levels(400, np.array([0, 5, 9]), np.array([500, 500, 2]))
    assert plain[0] - plain[1] == 0 and hot[0] - hot[1] == 2
    assert ngram_join.choose_levels(40, np.arange(40), np.full(40, 500)) == (0, 0)


def test_shingle_sets_do_not_depend_on_the_batch():
    texts = [t for _, t, *_ in messy()]
    together = list(shingle_sets(pa.array(texts, pa.string())))
    assert [len(s) for s in together] == [len(shingles(t)) for t in texts]
    for text, found in zip(texts, together, strict=True):
        (alone,) = shingle_sets(pa.array([text], pa.large_string()))
        assert np.array_equal(alone, found)


def test_shingle_sets_of_texts_in_stretches(monkeypatch):
    """A text longer than a stretch, with words across its borders and one longer than it, gives the same set."""
    rng = random.Random(8)
    words = [rng.choice(["a", "word", "x" * 9, "y" * 40, "z" * 300]) + str(rng.randrange(90)) for _ in range(900)]
    texts = ["  " + " ".join(words), "\n".join(words[:50]) + "\t\t", "q" * 1000, " " * 700]
    want = list(shingle_sets(pa.array(texts)))
    for size in (64, 100, 257):
        monkeypatch.setattr(shingle_module, "GROUP_BYTES", size)
        found = list(shingle_sets(pa.array([*texts, "short one", None])))
        assert all(np.array_equal(a, b) for a, b in zip(want, found))
        assert [len(s) for s in found] == [len(shingles(t)) for t in [*texts, "short one", None]]


def test_a_text_of_a_million_words_keeps_little():
    """What stays in a worker after a long text is the powers of one stretch."""
    text = " ".join(f"w{i % 99991}" for i in range(1_000_000))
    (found,) = shingle_sets(pa.array([text]))
    assert len(found) == 99991
    assert len(shingle_module.POWERS.up) <= 2 * shingle_module.GROUP_BYTES + 1


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    found = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert found == {x: p for x, p in parent.items() if x != p}


def test_one_of_each_group_stays(spark, corpus):
    docs = frame(spark, corpus, clash=True)
    kept = ngram_join.drop_near_copies(docs)
    want = sorted((i for i, _, c in brute(corpus) if i is None or i == c), key=repr)
    assert kept.columns[0] == "doc_id" and set(kept.columns) == set(docs.columns)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == want


def test_empty_table(spark):
    empty = frame(spark, [])
    assert ngram_join.near_duplicate_components(empty).count() == 0
    assert ngram_join.drop_near_copies(empty).count() == 0
