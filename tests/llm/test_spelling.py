import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import LOW, document, frame, messy, tuples

from merscope.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    words = counted(rows)
    out, form = {}, {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if one_edit(w, v))
        top = (near[0][1], -near[0][0]) if near and -near[0][0] >= 10 * n else (None, None)
        form[w] = top[0]
        out[w] = (n, len(near), top[1])
    result = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        result.append((w, form[w], root, *out[w]))
    return sorted(result, key=repr)


def edit(rng, word):
    letters = string.ascii_lowercase + "éàü"
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])


@pytest.fixture(scope="module")
def corpus():
    """Frequent words with rarer variants and variants of these, in many documents."""
    rng = random.Random(12)
    bases = ["".join(rng.choices("abcdeilnorstéè", k=rng.randrange(7, 13))) for _ in range(25)]
    words = []
    for base in bases:
        words += [base] * rng.choice([30, 120, 400])
        for _ in range(4):
            once = edit(rng, base)
            words += [once] * rng.choice([1, 2, 3, 20])
            words += [edit(rng, once)] * 2
    rng.shuffle(words)
    rows = messy()
    for i in range(0, len(words), 60):
        chosen = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words[i : i + 60]]
        rows.append(document(500 + i, " ".join(chosen)))
    return rows


def test_against_brute_force(spark, corpus):
    found = spelling.spelling_variants(frame(spark, corpus, clash=True))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(corpus)
    assert tuples(found) == want
    assert any(r[2] not in (r[0], r[1]) for r in want) and max(r[4] for r in want) > 5


@pytest.mark.parametrize("cell", [1, 4, 50])
def test_many_cells_give_the_same(spark, corpus, monkeypatch, cell):
    """Cells of a few words, so that most near pairs lie in two."""
    original = spelling.grow

    def small(points, most):
        return original(points, min(most, cell) if most != spelling.LEAF else 2)

    monkeypatch.setattr(spelling, "grow", small)
    assert tuples(spelling.spelling_variants(frame(spark, corpus))) == brute(corpus)


def test_a_sample_decides_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(spelling, "SAMPLE", 20)
    assert tuples(spelling.spelling_variants(frame(spark, corpus))) == brute(corpus)


def test_stretches_and_small_tasks_give_the_same(spark, corpus, monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 16)
    monkeypatch.setattr(spelling, "HELD", 10)
    assert {r["word"]: r["n"] for r in spelling.word_counts(frame(spark, corpus)).collect()} == counted(corpus)


def test_runs_are_those_of_the_pattern():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("abcABCéÀÿ×÷ĀŁ日🙂 .1\n-", weights=[9] * 9 + [2] * 2 + [1] * 9, k=rng.randrange(120)))
        found = [r.decode() for r in spelling.runs(np.frombuffer(text.encode(), np.uint8))]
        assert found == [r.translate(LOW) for r in RUN.findall(text) if len(r) >= 7]


def test_trees_reach_all_points_in_the_box():
    rng = np.random.default_rng(2)
    words = rng.integers(97, 104, (400, 8)).astype(np.uint8)
    points = spelling.letter_counts(words)
    tree = spelling.grow(points, 5)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(400))
    where = {p: i for i, leaf in enumerate(tree.leaves) for p in leaf.tolist()}
    for more, less in ((True, True), (True, False), (False, False)):
        seen = Counter((leaf, row) for leaf, rows in spelling.reached(tree, points, more, less) for row in rows.tolist())
        assert max(seen.values()) == 1
        for q in range(0, 400, 7):
            gap = points.astype(int) - points[q].astype(int)
            up, down = np.maximum(gap, 0).sum(axis=1), np.maximum(-gap, 0).sum(axis=1)
            for p in np.flatnonzero((up <= more) & (down <= less)).tolist():
                assert (where[p], q) in seen


def test_one_letter_more():
    rng = random.Random(3)
    short = ["".join(rng.choices("ab", k=7)) for _ in range(300)]
    long = [edit_in(rng, s) if rng.random() < 0.5 else "".join(rng.choices("ab", k=8)) for s in short]
    a, b = (np.array([list(w.encode()) for w in x], np.uint8) for x in (short, long))
    assert spelling.one_letter_more(a, b).tolist() == [one_edit(s, t) for s, t in zip(short, long)]


def edit_in(rng, word):
    at = rng.randrange(len(word) + 1)
    return word[:at] + rng.choice("ab") + word[at:]


def test_very_long_words(spark):
    long = "ab" * 50_000
    rows = [document(i, f"{long} {long[:-1]} {long}c short") for i in range(1, 4)]
    found = {(len(w), n_near) for w, _, _, _, n_near, _ in tuples(spelling.spelling_variants(frame(spark, rows)))}
    assert found == {(len(w), n_near) for w, _, _, _, n_near, _ in brute(rows)}


def test_cells_hold_points_before_queries():
    """Rows of a cell may come in any number of batches."""
    words = [b"abcdefg", b"abcdefh", b"abcdefi"]
    columns = [[7] * 3, [0] * 3, [0, 0, 1], words, [5, 1, 2]]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
    names = ["size", "cell", "kind", "code", "n"]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
    for batches in ([whole], [whole.slice(i, 1) for i in range(3)]):
        found = sorted(tuple(r.values()) for b in spelling.search_cells(iter(batches)) for r in b.to_pylist())
        assert found == [(b"abcdefg", 2, 2, b"abcdefi"), (b"abcdefh", 2, 5, b"abcdefg"), (b"abcdefi", 2, 5, b"abcdefg")]


def test_empty_table(spark):
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    assert spelling.spelling_variants(frame(spark, [document(1, None), document(2, "short words only")])).count() == 0
