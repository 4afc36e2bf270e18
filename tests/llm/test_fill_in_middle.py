import hashlib
import random
import re

import pytest
from helpers import document, frame, messy, tuples
from pyspark.sql import functions as F

from merscope.llm import fill_in_middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    """Output and digests by plain Python."""
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


ODD = [
    "<P> inside", "a<S>b", "x<M>", "<P", "<<P", "P><S", "$1 \\1 $ {2} (a) [b] \\", "日本 text 🙂🙂 é́ ß", "\r\n \x85 line ends \n",
    "A" * 5000, "....", "a.b.c.d", "<", ">", "<S", "tail <", "\x00 zero",
]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows = messy() + [document(1000 + i, text) for i, text in enumerate(ODD * 12)]
    letters = "abXYZ é<>PSM.\n 1"
    rows += [document(3000 + i, "".join(rng.choices(letters, k=rng.randrange(40)))) for i in range(300)]
    return rows


def test_against_brute_force(spark, corpus):
    found = fill_in_middle.digests(frame(spark, corpus, clash=True))
    assert tuples(found) == sorted((brute(i, t) for i, t, *_ in corpus), key=repr)


def test_every_form_occurs_and_texts_come_back(spark, corpus):
    rows = fill_in_middle.transformed(frame(spark, corpus)).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert all(r["back"] == r["text"] for r in rows)


def test_other_shares(spark):
    docs = frame(spark, [document(i, f"text number {i} of some words") for i in range(200)])
    none = fill_in_middle.transformed(docs, changed_percent=0)
    assert none.where("form <> 'plain' OR output <> text").count() == 0
    all_ = fill_in_middle.transformed(docs, changed_percent=100, suffix_first_percent=100, salt="other:")
    assert all_.where("form <> 'spm'").count() == 0


def test_a_text_of_a_million_units(spark):
    """Possessive groups need no stack for what they have matched."""
    text = "ab, " * 400_000
    rows = [document(i, text) for i in range(6)]
    assert tuples(fill_in_middle.digests(frame(spark, rows))) == sorted((brute(i, text) for i in range(6)), key=repr)


def test_nothing_is_shuffled(spark, corpus):
    plan = fill_in_middle.digests(frame(spark, corpus))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_empty_table(spark):
    assert fill_in_middle.digests(frame(spark, [])).count() == 0
