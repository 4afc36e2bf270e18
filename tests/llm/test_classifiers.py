"""Language ID, toxicity and quality: held-out accuracy and odd rows."""

import random

import numpy as np
import pandas as pd
import pytest
from helpers import crc, document, frame, messy
from pyspark.sql import functions as F

from merscope.llm import language_id, quality, samples, toxicity

TOPS = {"en": "the and with this there where river stone", "de": "der und nicht werden straße fluss stein über", "fr": "les dans avec être rivière pierre où même"}
LABELS = "doc_id bigint, quality int, toxic int"


def sentence(rng, lang, n):
    return " ".join(rng.choice(TOPS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    rows = []
    for i in range(600):
        lang = rng.choice(list(TOPS))
        rows.append(document(i + 1000, sentence(rng, lang, rng.randint(8, 80)), lang))
    return rows


def test_languages_held_out(spark, texts):
    found = {r["doc_id"]: r for r in language_id.identify_documents(frame(spark, texts)).collect()}
    out = [r for r in texts if crc(r[0]) % 4 == 2]
    assert all(found[r[0]]["held_out"] for r in out) and len(out) > 100
    assert np.mean([found[r[0]]["lang_pred"] == r[2] for r in out]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_ignores_labels_of_held_out_rows(spark, texts):
    changed = [document(i, t, "xx" if crc(i) % 4 == 2 else lang) for i, t, lang, *_ in texts]
    plain = language_id.identify_documents(frame(spark, texts)).collect()
    assert sorted(plain) == sorted(language_id.identify_documents(frame(spark, changed)).collect())


def test_languages_of_messy_rows(spark):
    rows = messy()
    found = language_id.identify_documents(frame(spark, rows, clash=True)).collect()
    assert len(found) == len(rows)
    und = sorted((r["doc_id"] for r in found if r["lang_pred"] == "und"), key=repr)
    assert und == sorted([3, 4, 5, 7, None], key=repr)
    kept = language_id.drop_rejected(frame(spark, rows, clash=True))
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not {3, 4, 5, 7} & {r["doc_id"] for r in kept.collect()}


def test_dictionaries_reach_behind_shared_headers(spark):
    rng = random.Random(3)
    head = sentence(rng, "en", 250)
    assert len(head) > 768
    rows = [document(i, sentence(rng, "en", 60), "en") for i in range(200)]
    rows += [document(1000 + i, f"{head} {sentence(rng, 'fr', 250)}", "fr") for i in range(200)]
    rows += [document(2000 + i, f"{'17 ' * 400} {sentence(rng, 'de', 60)}", "de") for i in range(200)]
    sizer = language_id.Sizer(language_id.learn(frame(spark, rows)))
    for lang in TOPS:
        assert np.mean([sizer.identify(sentence(rng, lang, 30))[0] == lang for _ in range(50)]) > 0.95
    assert all(text.strip() for _, text in language_id.learn(frame(spark, rows)).content)


def test_copies_do_not_fill_the_draw(spark):
    texts = ["copy of the one text"] * 2000 + [f"rare{chr(97 + i)} words of its own" for i in range(20)]
    found = dict(language_id.learn(frame(spark, [document(i, t) for i, t in enumerate(texts)])).content)
    used = [t for i, t in enumerate(texts) if i >= 2000 and crc(i) % 4 != 2]
    assert all(t.split()[0].encode() in found["en"] for t in used)
    assert found["en"].count(b"copy of the one text") == 1


def test_pieces_come_from_the_whole_text():
    text = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(500))
    places = [text.index(p) for p in (language_id.spread(text)[i * 129 : i * 129 + 128] for i in range(6))]
    assert all(len(text) * i // 6 <= at <= len(text) * (i + 1) // 6 - 128 for i, at in enumerate(places))
    assert language_id.spread("1, Short 2") == "short"


def tongue(rng, i):
    """Words of a made-up language."""
    own = random.Random(i)
    words = ["".join(own.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8)]
    return " ".join(rng.choice(words) for _ in range(40))


def test_every_language_is_learnt(spark):
    rng = random.Random(9)
    rows = [document(1000 * i + k, tongue(rng, i), f"l{i:03}") for i in range(300) for k in range(6)]
    found = {r["doc_id"]: r for r in language_id.identify_documents(frame(spark, rows)).collect()}
    learnt = {r[2] for r in rows if crc(r[0]) % 4 != 2}
    assert len(learnt) > 295
    known = [r for r in rows if r[2] in learnt]
    assert all(found[r[0]]["lang_pred"] == r[2] and found[r[0]]["accepted"] for r in known)


def test_blocks_of_languages_give_the_same():
    rng = random.Random(2)
    content = [(f"l{i}", tongue(rng, i).encode()) for i in range(7)]
    content += [("tie", content[2][1])]
    texts = [tongue(rng, i) for i in range(7)] + [tongue(rng, 1)[:60] + tongue(rng, 5), "zzz", "1", None, "long " * 9000]
    dictionaries = language_id.Dictionaries(tuple(content))
    whole = [language_id.Sizer(dictionaries).identify(t) for t in texts]
    for at_once in (1, 2, 3, 8, 64):
        found = list(language_id.identify_batches(iter([pd.Series(texts[:5]), pd.Series(texts[5:])]), dictionaries, at_once))
        assert [tuple(r) for f in found for r in f.itertuples(index=False)] == whole
    assert whole[2] == ("l2", 0.0, False)


def test_narrow_margins_are_rejected():
    sizer = language_id.Sizer(language_id.Dictionaries((("a", b"alpha beta gamma " * 20), ("b", b"alpha beta gamma " * 20))))
    assert sizer.identify("alpha beta gamma delta") == ("a", 0.0, False)
    assert language_id.Sizer(language_id.Dictionaries(())).identify("text") == ("und", 0.0, False)


def test_nothing_to_learn(spark):
    rows = [document(i, "some text", None) for i in range(5)]
    assert {r["lang_pred"] for r in language_id.identify_documents(frame(spark, rows)).collect()} == {"und"}
    assert language_id.identify_documents(frame(spark, [])).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.score_documents(frame(spark, rows), none).collect()} == {0.0}
    assert {r["score"] for r in quality.score_documents(frame(spark, rows), none).collect()} == {0.5}
    for scored in (toxicity, quality):
        assert scored.score_documents(frame(spark, []), none).count() == 0


@pytest.fixture(scope="module")
def judged(texts):
    rng = random.Random(5)
    rows, labels = [], []
    for i, text, lang, source, _ in texts:
        toxic, good = rng.random() < 0.15, rng.random() < 0.8
        w = text.split()
        if toxic:
            w.insert(rng.randrange(len(w)), f"nasty{rng.choice(['ly', 'er', 'ness', ''])}")
        if not good:
            w = [x + "%%%" for x in w]
        rows.append(document(i, " ".join(w), lang, source))
        if rng.random() < 0.7:
            labels.append((i, int(good), int(toxic)))
    truth = {r[0]: ("nasty" in r[1], "%%%" not in r[1]) for r in rows}
    return rows, labels, truth


@pytest.mark.parametrize("module, which", [(toxicity, 0), (quality, 1)])
def test_held_out_accuracy(spark, judged, module, which):
    rows, labels, truth = judged
    found = module.score_documents(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    out = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i in truth if crc(i) % 5 == 0} and len(found) == len(rows)
    assert np.mean([bool(r["predicted"]) == truth[r["doc_id"]][which] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_labels_of_held_out_rows_do_not_count(spark, judged, module):
    rows, labels, _ = judged
    changed = [(i, 1 - q, 1 - t) if crc(i) % 5 == 0 else (i, q, t) for i, q, t in labels]
    one, two = (module.score_documents(frame(spark, rows), spark.createDataFrame(x, LABELS)).collect() for x in (labels, changed))
    assert sorted(one) == sorted(two)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_messy_rows(spark, module):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 1), (3, None, None), (None, 1, 1), (6, 1, 0), (8, 0, 0)], LABELS)
    rows = messy()
    found = module.score_documents(frame(spark, rows, clash=True), labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)


def test_risk_is_not_driven_below_zero():
    """Separable positives, a tenth of them hidden in the unlabelled rows."""
    rng = np.random.default_rng(0)
    positive = np.hstack([np.ones((200, 1)), rng.integers(0, 2, (200, 30))])
    unlabelled = np.hstack([(np.arange(2000) < 200)[:, None], rng.integers(0, 2, (2000, 30))])
    weights, bias = toxicity.fit_nnpu(positive, unlabelled, 0.1)
    z = unlabelled @ weights + bias
    assert (z[:200] > 0).mean() > 0.98 and (z[200:] < 0).mean() > 0.98


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    good = rng.random(800) < 0.7
    content = rng.normal(size=(800, quality.N_CONTENT)) + good[:, None] * 1.2
    metadata = [quality.metadata_numbers("good" if g else "bad", "en", 100) for g in good]
    label = np.where(np.arange(800) < 60, good, -1)
    model = quality.co_train(content, metadata, label)
    assert np.mean((model.score(content, metadata) >= 0.5) == good) > 0.97


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    docs = frame(spark, [document(1, f"text {i % 3}") for i in range(300)] + [document(i, None) for i in range(2, 30)])
    drawn = samples.lowest_hashes(docs.select("doc_id"), 20, "salt")
    assert len({r["doc_id"] for r in drawn.collect()}) == 20
    both = drawn.withColumn("label", F.lit(0)).unionByName(docs.select("doc_id").distinct().withColumn("label", F.lit(1)))
    rows = samples.with_columns_of(docs, both, ["text", "lang"]).collect()
    assert sorted((r["doc_id"], r["label"]) for r in rows) == sorted((r["doc_id"], r["label"]) for r in both.collect())
    assert len({r["text"] for r in rows if r["doc_id"] == 1}) == 1
