from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from granary.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def read(df):
    done = chat.format_conversations(df)
    rows = done.select(
        "conv_id", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("read"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    return {r.conv_id: r for r in rows.collect()}


def test_format(spark):
    rows = [(1, 2, "assistant", "c"), (1, 1, "user", "b"), (1, 0, "user", "a"), (1, 3, "assistant", "d\n")]
    got = read(spark.createDataFrame(rows, SCHEMA))[1]
    assert got.formatted == "<turn user\na<next/>b</turn>\n<turn assistant\nc<next/>d\n</turn>\n"
    assert [tuple(t) for t in got["read"]] == [("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "d\n")]
    assert got.loss == "cd\n"
    assert [got.formatted[s.start : s.start + s.length] for s in got.loss_spans] == ["c", "d\n"]


def test_round_trip(spark):
    rng = random.Random(2)
    bits = ["\\", "\\0", "\\1", "</turn>", "<turn ", "<next/>", "\n", "é😀", "a", "<", "0", "", "\\### Assistant: </turn> ok"]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 6)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "sy\nstem\\", None]), text))
    rng.shuffle(rows)
    got = read(spark.createDataFrame(rows, SCHEMA))
    for conv in range(150):
        mine = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        assert [tuple(t) for t in got[conv]["read"]] == mine
        assert got[conv].loss == "".join(t for role, t in mine if role == "assistant")
        assert got[conv].formatted.count("</turn>\n") == 1 + sum(a[0] != b[0] for a, b in zip(mine, mine[1:]))


def test_ties_nulls_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "first"), (None, 1, "user", "x"), (None, 0, None, None)]
    got = read(spark.createDataFrame(rows, SCHEMA).withColumn("turns", F.lit(1)))
    assert [t.text for t in got[1]["read"]] == ["first", "a", "a", "b"]
    assert [tuple(t) for t in got[None]["read"]] == [("", ""), ("user", "x")]
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_work_is_in_proportion_to_turns(spark):
    """One conversation of very many turns, formatted and read back."""
    took = []
    for n in (500, 8_000, 32_000):
        rows = spark.range(n).select(
            F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
            F.concat(F.lit("é😀 <turn "), F.col("id").cast("string"), F.lit(" x" * 40)).alias("text"),
        )
        began = time.time()
        done = chat.format_conversations(rows)
        r = done.select(F.size(chat.parse(F.col("formatted"))).alias("n"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
        took.append(time.time() - began)
        assert r.n == n and r.loss == "".join(f"é😀 <turn {i}" + " x" * 40 for i in range(n) if i % 3)
    assert took[2] < 8 * max(took[1], 1), took
