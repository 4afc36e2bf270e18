import hashlib
from collections import defaultdict

from helpers import CLASHES
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from merscope.llm import chat_format

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(spark, rows, clash=False):
    turns = spark.createDataFrame(rows, SCHEMA)
    for name in ["segments", "formatted", "turns", "valid"] + CLASHES if clash else []:
        turns = turns.withColumn(name, F.lit(1))
    return {r["conv_id"]: r for r in chat_format.format_digest(turns).collect()}


def check(got, rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        learnt = "".join(t[3] for t in turns if t[2] == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learnt), sha(learnt))


NASTY = ["<|/turn|>", "<|role:user|>", "<\\|role", "<\\\\|x", "<", "|>", "|", ">", "\\", "$1", "\\1", "<<|", "|\\>", ""]


def test_control_strings_come_back(spark):
    rows = [(c, t, role, text) for c, (a, b) in enumerate([(a, b) for a in NASTY for b in NASTY]) for t, (role, text) in enumerate([("user", a + b), ("assistant", b + a)])]
    rows += [(1000 + i, 0, a, "x") for i, a in enumerate(NASTY)]
    check(digest(spark, rows), rows)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|", None]), st.text("<|>\\/turn$é\n", max_size=12)), min_size=1, max_size=30))
def test_random_texts_come_back(spark, turns):
    rows = [(i % 4, i, role, text) for i, (role, text) in enumerate(turns)]
    check(digest(spark, rows), rows)


def test_nulls_ties_and_clashes(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", None), (2, 3, "assistant", "long " * 50_000)]
    check(digest(spark, rows, clash=True), rows)
    assert digest(spark, []) == {}


def test_state_machine(spark):
    orders = {1: "system user assistant user", 2: "user user", 3: "assistant", 4: "user assistant", 5: "user system", 6: "robot"}
    rows = [(c, t, role, "x") for c, roles in orders.items() for t, role in enumerate(roles.split())]
    turns = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: (r["valid"], r["first_bad_turn"]) for r in chat_format.format_conversations(turns).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (False, 0), 4: (True, None), 5: (False, 1), 6: (False, 0)}


def test_segments_make_up_the_text(spark):
    row = chat_format.format_conversations(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a<|b")], SCHEMA)).first()
    assert row["formatted"] == "<|role:user|>hi<|/turn|><|role:assistant|>a<\\|b<|/turn|>"
    assert "".join(s["text"] for s in row["segments"]) == row["formatted"]
    assert [s["text"] for s in row["segments"] if s["loss"]] == ["a<\\|b"]
