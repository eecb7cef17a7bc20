from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from salesmart.llm import chat

NASTY = ["", "\\", "\\\\", "</turn>", "\\</turn>", "<\\/turn>", "#", "##", "###", "####", "### Assistant: x", "</turn>\n### User: y", ": ", "a: b", "<", "</turn", "x\\", "\\/", "\\#", "é\n\n日", " "]
SCHEMA = "tree_id long, message_id long, parent_id long, role string, text string, score double, formatted string"


def read(df):
    turns = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.struct(t["role"], t["text"]))
    out = df.select("tree_id", "rank", "n_turns", turns.alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {(r[0], r[1]): (r[2], [tuple(t) for t in r[3]], r[4]) for r in out.collect()}


def test_any_text_and_role_is_restored(spark):
    draw = random.Random(3)
    rows, want = [], {}
    for tree in range(120):
        turns = [(draw.choice(["user", "assistant", "system", "User", "=x", "a: b:", "\\", "</turn>", "###"]), "".join(draw.choices(NASTY, k=draw.randrange(4)))) for _ in range(1 + draw.randrange(5))]
        want[tree] = turns
        rows += [(tree, k, role, text) for k, (role, text) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = read(chat.format_trees(chat.chains(table)))
    assert {t: turns for (t, _), (_, turns, _) in got.items()} == want
    assert all(loss == "".join(x for r, x in want[t] if r == "assistant") for (t, _), (_, _, loss) in got.items())


def test_best_branches_of_a_tree(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0, "clash"),
        (1, 2, 1, "assistant", "bad", -1.0, None),
        (1, 3, 1, "assistant", "good", 2.0, None),
        (1, 4, 3, "user", "more", 2.0, None),
        (1, 5, 4, "assistant", "best", 2.0, None),
        (1, 5, 4, "assistant", "best", 2.0, None),  # a repeated row
        (1, 6, 3, "user", None, 2.0, None),
        (2, 1, 99, "user", "its parent is missing", None, None),
        (3, 1, 2, "user", "round", 1.0, None),
        (3, 2, 1, "user", "and round", 1.0, None),
        (None, 7, None, None, None, None, None),
        (4, None, None, "user", "no id", 1.0, None),
    ]
    got = read(chat.format_trees(spark.createDataFrame(rows, SCHEMA), branches=2))
    assert got == {
        (1, 1): (4, [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "best")], "goodbest"),
        (1, 2): (3, [("user", "q"), ("assistant", "good"), ("user", "")], "good"),
        (2, 1): (1, [("user", "its parent is missing")], ""),
        (None, 1): (1, [("", "")], ""),
    }


def test_long_chains_take_few_rounds(spark):
    rows = [(9, k, k - 1 if k else None, "user", str(k), 0.0, None) for k in range(70)]
    ((_, turns, _),) = read(chat.format_trees(spark.createDataFrame(rows, SCHEMA))).values()
    assert turns == [("user", str(k)) for k in range(70)]


def test_empty_table(spark):
    assert read(chat.format_trees(spark.createDataFrame([], SCHEMA))) == {}


@pytest.mark.parametrize("same_turn", [False, True])
def test_repeated_rows_of_a_conversation_all_count(spark, same_turn):
    rows = [(1, 0, "user", "b"), (1, 0 if same_turn else 1, "user", "a"), (1, 0 if same_turn else 1, "user", "a")]
    ((n, turns, _),) = read(chat.format_trees(chat.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).values()
    assert n == 3
    assert turns == ([("user", "a"), ("user", "a"), ("user", "b")] if same_turn else [("user", "b"), ("user", "a"), ("user", "a")])


def test_no_python_in_the_plan(spark):
    rows = [(1, 0, "user", "b")]
    made = chat.format_trees(chat.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert hashlib.sha256(made.first()["formatted"].encode()).hexdigest() == hashlib.sha256(b"### User: b</turn>\n").hexdigest()
