"""Quotes of parts of messages, and their origins in other conversations."""

import numbers
import random

import duckdb
import pandas as pd
import pytest

from reprolens.llm import quotes


def linked(spark, rows):
    frame = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    return {(r.conv_id, r.turn): (r.to_conv, r.to_turn) for r in quotes.link(spark, frame).collect()}


def test_excerpts_of_several_lines(spark):
    original = "a b\nc d\n\ne f\ng h"
    rows = [(1, 0, original), (1, 1, "> a b\n> c d\nyes"), (1, 2, "> C d,\n>\n> e f"), (1, 3, "> c d\n> a b"), (1, 4, "> a b\n> e f"), (2, 0, "x\n> q\na b\n> q\nc d"), (3, 0, "> g h\n> more")]
    got = linked(spark, rows)
    assert (got[1, 1], got[1, 2]) == ((1, 0), (1, 0))
    assert got[1, 3] == got[1, 4] == got[3, 0] == (None, None)
    assert linked(spark, [(1, 0, "> a b\n> c d"), (2, 0, "x\n> q\na b\n> q\nc d")])[1, 0] == (None, None)


def test_origin_in_the_next_conversation(spark):
    rows = [(1, 3, "> P"), (1, 5, "p"), (2, 0, "p"), (2, 4, "> p"), (3, 0, "> p"), (4, 0, "> alone"), (4, 1, "alone")]
    assert linked(spark, rows) == {(1, 3): (2, 0), (2, 4): (2, 0), (3, 0): (1, 5), (4, 0): (None, None)}


@pytest.mark.parametrize("seed", range(3))
def test_conversations_equal_sql(spark, seed):
    r = random.Random(seed)
    lines = [f"line {i} of talk" for i in range(12)] + ["", "  ", "é Ü!", "--"]
    rows = []
    for c in range(14):
        for turn in range(r.randint(1, 6)):
            said = [r.choice(lines) for _ in range(r.randint(1, 5))]
            if rows and r.random() < 0.6:
                source = (r.choice(rows)[3] or "").split("\n")
                at = r.randrange(len(source))
                mark = r.choice([">", "> ", ">>", " > > "])
                said = [mark + r.choice([x, x.upper(), x + "!"]) for x in source[at : at + r.randint(1, 3)]] + said[: r.randint(0, 3)]
            rows.append((c, turn, r.choice(["user", "assistant"]), r.choice(["\n", "\n", "\r\n"]).join(said) if r.random() < 0.95 else None))
    rows += [(None, 0, "user", "x"), (3, None, "user", "x"), rows[4], (rows[5][0], rows[5][1], "zz", "other text")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conversations = frame.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841  read by DuckDB
    want = duckdb.sql(quotes.ORACLE).df().astype(object)
    got = quotes.conversations(spark, frame).toPandas().astype(object)
    cell = lambda v: "~" if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, numbers.Number) else str(v)
    clean = lambda f: sorted(tuple(map(cell, row)) for row in f[sorted(f.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and clean(got) == clean(want)
    assert got.n_linked.sum() > 3


def test_odd_conversations(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.conversations(spark, frame).count() == 0
    rows = [(1, 0, "user", ""), (1, 1, None, "> "), (1, 2, "user", "> x\n" * 500 + "w " * 20_000), (2, 0, "user", "x"), (2, 0, "user", "x")]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 4 and got[1, 1].n_quotes == 0 and got[1, 2].n_quotes == 1
