import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "[", "<", "/", " ", "a", "[INST] ", " [/INST]", " </s>", "[/INST] ", "é", "\n", "INST]", "s>", "<s", "🤦"]


def source(rows):
    out = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out[c].append((r or "", x or "", r == "assistant"))
    return out


def test_round_trip(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "<s>", "[INST] ", "sys\\tem", None, ""]), "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 7))) if rnd.random() < 0.9 else None) for c in range(800) for t in range(rnd.randint(1, 4))]
    out = {r.conv_id: [tuple(x) for x in r.turns] for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == source(rows)


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "plain [text] < here \\ ok"), (1, 1, "assistant", "fine"), (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "a\\\\b")]
    got = {r.conv_id: r.formatted for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == "<s>user[INST] plain [text] < here \\ ok [/INST]<s>assistant[/INST] fine </s>"
    assert got[2] == "<s>user[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]<s>assistant[/INST] a\\\\\\\\b </s>"


def test_odd_rows(spark):
    rows = [(1, None, "assistant", "x"), (1, 0, "user", None), (1, 0, "user", None), (None, 1, None, "y"), (2, 0, "assistant", "z" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit(1))
    out = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert {c: [tuple(t) for t in r.turns] for c, r in out.items()} == source(rows)
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
    d = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert (d[1].n_turns, d[1].loss_chars, d[2].loss_chars) == (3, 1, 100_000)


def test_no_python_in_the_plan(spark):
    plan = chat.digests(chat.format_chats(spark.createDataFrame([], SCHEMA).union(spark.range(1).selectExpr("id", "id", "'a'", "'b'"))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("bad", ["user[INST] x", "user x", "user[INST] x </s>", "user[/INST] x [/INST]", "user[INST] a [INST] b [/INST]", ""])
def test_parser_rejects(spark, bad):
    r = spark.createDataFrame([(bad,)], "p string").select(chat.parse_turn(F.col("p")).alias("t")).first().t
    assert not r.ok
