import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import document, frame, messy
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from merscope.llm import packing, tokens

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def encoder():
    return tokens.CachedEncoder(PATH)


def direct(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


ODD = ["It's I'LL ,'s '' 'x", "<|endoftext|> a<|endoftext|>b", "é é É ß ẞ İ ΑΣ σς", "a\x1cb\x1f c\x85d e f", "１２ ² ½ ª µ º × ÷", "日本語 text 🙂🙂 !?", "a\x00b ﻿ ​", "", "   ", "%%%&&& a_b __ 12ab"]


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(encoder, text):
    assert list(struct.unpack(f"<{len(encoder.encode(text)) // 4}I", encoder.encode(text))) == direct(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abAB'ésS tl. ,\n<|>1²́\x1cßİ-"), max_size=40))
def test_ids_of_random_texts(text):
    found = tokens.CachedEncoder.__new__(tokens.CachedEncoder)
    found.__dict__ = SHARED.__dict__
    assert list(struct.unpack(f"<{len(found.encode(text)) // 4}I", found.encode(text))) == SHARED.tokenizer.encode(text, add_special_tokens=False).ids


SHARED = tokens.CachedEncoder(PATH)


def test_bounded_caches_give_the_same(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_CHUNKS", 3)
    monkeypatch.setattr(tokens, "MOST_PIECES", 3)
    small = tokens.CachedEncoder(PATH)
    for text in [*ODD, *ODD, "one two three four five six seven one two"]:
        assert list(struct.unpack(f"<{len(small.encode(text)) // 4}I", small.encode(text))) == direct(text)


def check_layout(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_messy_documents(spark):
    rows = messy()
    found = packing.pack_documents(frame(spark, rows, clash=True), PATH, capacity=64).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = direct(text or "") + [0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want.append((doc_id, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(want, key=repr)
    sequences = check_layout(found, 64)
    assert sequences <= 1.05 * sum(w[3] for w in want) / 64 + 1


def test_sequences_hold_the_ids(spark):
    docs = frame(spark, [document(i, f"text number {i} " * i) for i in range(40)])
    packed = packing.pack_documents(docs, PATH, capacity=32, with_ids=True)
    ids = [x for r in packing.packed_sequences(packed).collect() for x in r["ids"]]
    assert Counter(ids) == Counter(x for i in range(40) for x in direct(f"text number {i} " * i) + [0])


def test_empty_table(spark):
    assert packing.pack_documents(frame(spark, []), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), max_size=25))
def test_plans_place_every_piece(counts):
    plan = packing.plan_packing(counts, 100)
    placed, used = Counter(), defaultdict(set)
    ends = {}
    for length in counts:
        rows = sorted(r for r in plan.rows if r[0] == length)
        ends[length] = [r[1] for r in rows[1:]] + [counts[length]]
        for (_, rank, first, per, offset), end in zip(rows, ends[length], strict=True):
            for k in range(end - rank):
                placed[length] += 1
                begin = offset + k % per * length
                cells = set(range(begin, begin + length))
                assert begin + length <= 100 and not cells & used[first + k // per]
                used[first + k // per] |= cells
    assert placed == Counter(counts)
    assert all(cells == set(range(len(cells))) for cells in used.values())


def test_few_sequences():
    rng = random.Random(2)
    counts = Counter(min(2048, int(rng.lognormvariate(6.3, 1))) or 1 for _ in range(20_000))
    plan = packing.plan_packing(dict(counts))
    assert plan.sequences <= 1.02 * sum(s * n for s, n in counts.items()) / 2048


def test_configurations_are_optimal():
    """No configuration has a price above 1, whatever the number of sizes."""
    rng = random.Random(8)
    for count in (3, 40, 150):
        sizes = sorted(rng.sample(range(350, 2048), count), reverse=True)
        need = [rng.randrange(1, 400) for _ in sizes]
        found = packing.optimal_configurations(sizes, need, 2048)
        columns = np.array([taken for taken, _ in found]).T
        assert all(taken @ sizes <= 2048 for taken, _ in found)
        assert np.allclose(columns @ [times for _, times in found], need, atol=0.01)
        price = np.linalg.solve(columns.T, np.ones(count))
        assert price @ packing.best_configuration(sizes, price, 2048) <= 1 + 1e-6


def test_lengths_that_most_pieces_share(spark, monkeypatch):
    """Ranks counted in many buckets are those of one count; full pieces get numbers of their own."""
    monkeypatch.setattr(packing, "PER_BUCKET", 7)
    rows = [document(i, "same text again") for i in range(300)] + [document(900 + i, "word " * 64) for i in range(9)]
    found = packing.pack_documents(frame(spark, rows), PATH, capacity=32).collect()
    check_layout(found, 32)
    full = [r for r in found if r["length"] == 32]
    assert len(full) == 18 and len({r["sequence_id"] for r in full}) == 18


def test_long_chunks_are_not_remembered(encoder):
    long = "ab" * 5000
    raw = encoder.encode(f"{long} tail {long}1")
    assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == direct(f"{long} tail {long}1")
    assert max(map(len, encoder.chunks)) <= tokens.LONGEST


def test_new_words_of_many_texts_are_learned_at_once(monkeypatch):
    from merscope.llm import tokens

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé'9-A", k=rng.randint(1, 9))) for _ in range(3000)] + ["x" * 300, "日本", "<|a", "it's"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(300)] + ["a\x1cb", "", " \n "]
    encoder = tokens.CachedEncoder(PATH)
    calls, learn = [], encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda chunks: (calls.append(len(chunks)), learn(chunks)))
    assert list(encoder.encode_all(texts)) == [encoder.direct(text) for text in texts]
    assert len(calls) == 1
    monkeypatch.setattr(tokens, "GROUP", 500)
    monkeypatch.setattr(tokens, "MOST_CHUNKS", 200)
    monkeypatch.setattr(tokens, "MOST_PIECES", 100)
    again = tokens.CachedEncoder(PATH)
    assert list(again.encode_all(texts)) == [encoder.direct(text) for text in texts]


def test_words_that_keep_coming_are_learned_once(monkeypatch):
    monkeypatch.setattr(tokens, "GROUP", 1000)
    monkeypatch.setattr(tokens, "MOST_CHUNKS", 300)
    monkeypatch.setattr(tokens, "MOST_PIECES", 0)
    rng = random.Random(5)
    texts = [f"common Words, {' '.join(''.join(rng.choices('abcdefgh', k=9)) for _ in range(95))}" for _ in range(40)]
    encoder = tokens.CachedEncoder(PATH)
    learned, learn, most = Counter(), encoder.learn, []
    monkeypatch.setattr(encoder, "learn", lambda chunks: (learned.update(chunks), learn(chunks), most.append(len(encoder.chunks))))
    assert list(encoder.encode_all(texts)) == [encoder.direct(text) for text in texts]
    assert learned["common"] == learned["Words,"] == 1
    assert max(most) < 300 + 200


def column(encoder, texts):
    ids, borders = encoder.encode_column(texts)
    assert len(borders) == len(texts) + 1
    return [ids[a:b].tolist() for a, b in zip(borders, borders[1:])]


PARTS = ["'s", "'", "l", "re", "'Ve", "S", "T", "d", "m", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "é", "É", "ß", "ẞ", "×", "÷", "Ö", "ÿ", "²", "1", "23", "<", "|", "<|endoftext|>", "日", "\u0301", "a", "B", "İ", "\x00", "-", ".", "À"]


@pytest.mark.parametrize("stretch", [7, 1 << 21])
def test_columns_have_the_ids_of_their_texts(monkeypatch, stretch):
    monkeypatch.setattr(tokens, "STRETCH", stretch)
    rng = random.Random(9)
    encoder = tokens.CachedEncoder(PATH)
    assert column(encoder, []) == [] and column(encoder, ["", ""]) == [[], []]
    assert column(encoder, ODD) == [direct(text) for text in ODD]
    for _ in range(60):
        texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(rng.randint(0, 30))]
        assert column(encoder, texts) == [list(struct.unpack(f"<{len(raw) // 4}I", raw)) for raw in map(encoder.direct, texts)]


def test_rows_of_the_table_are_bounded(monkeypatch):
    """Long pieces are forgotten, frequent ones learned once, and a full table gives the same ids."""
    monkeypatch.setattr(tokens, "STRETCH", 1000)
    monkeypatch.setattr(tokens, "MOST_ROWS", 300)
    rng = random.Random(5)
    texts = [f"common Words, {' '.join(''.join(rng.choices('abcdefgh', k=9)) for _ in range(95))}" for _ in range(40)]
    texts += ["ab" * 300 + " tail " + "日本" * 300 + " tail"] * 3 + texts[:5]
    encoder = tokens.CachedEncoder(PATH)
    learned, some, most = Counter(), encoder.encode_some, []
    monkeypatch.setattr(encoder, "encode_some", lambda pieces: (learned.update(pieces), most.append(len(encoder.pieces)), some(pieces))[2])
    assert column(encoder, texts) == [np.frombuffer(encoder.direct(text), "<u4").tolist() for text in texts]
    assert learned["common"] == learned["words"] == learned[","] == 1
    assert max(most) <= 300
    column(encoder, ["end"])
    assert max(map(len, encoder.pieces.to_pylist())) <= tokens.LONGEST


def test_only_new_pieces_of_a_table_are_strings(spark, monkeypatch):
    """Packing cuts and looks up pieces in arrays: words that were seen are not looked up one by one."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeé", k=6)) for _ in range(50)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": [" ".join(rng.choices(words, k=40)) for _ in range(200)]})
    learned, some = [], tokens.CachedEncoder.encode_some
    monkeypatch.setattr(tokens.CachedEncoder, "encode_some", lambda self, pieces: (learned.extend(pieces), some(self, pieces))[1])
    monkeypatch.setattr(tokens.CachedEncoder, "encode_all", lambda self, texts: iter([None for _ in texts]))
    cut = []
    docs = frame(spark, [document(1, "a")])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, step, fields: cut.append(step))
    packing.token_pieces(docs, PATH)
    rows = pa.Table.from_batches(cut[0](iter([batch, batch])))
    assert rows["length"].to_pylist() == [len(direct(text)) + 1 for text in batch["text"].to_pylist()] * 2
    assert len(learned) == len(set(learned)) <= 50
