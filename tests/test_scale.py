"""Statistics and corpus operators on inputs that break plain formulas or plain plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reprolens.functions import text
from reprolens.operators import corpus, evaluation, extraction, stats


def test_rank_sum_of_many_equal_numbers(spark):
    rows = spark.range(2_200_000).select((F.col("id") % 2 == 0).alias("side"), F.lit(1.0).alias("v")).unionByName(spark.createDataFrame([(True, 2.0)], "side boolean, v double"))
    got = stats.mann_whitney(rows, F.col("side"), "v").first()
    assert got.n1 == 1_100_001 and got.n2 == 1_100_000 and got.u == pytest.approx(1_100_001 * 1_100_000 / 2 + 1_100_000 / 2)


@pytest.mark.parametrize("group", [(), ("g",)])
def test_rank_correlation_equals_ranks(spark, group):
    import pandas as pd

    r = np.random.default_rng(4)
    frame = pd.DataFrame({"g": r.choice(["a", "b"], 400), "x": r.integers(0, 30, 400), "y": r.normal(size=400).round(1)})
    frame.loc[::50, "y"] = np.nan
    rows = spark.createDataFrame([(None if i % 7 == 0 else t.g, int(t.x), None if t.y != t.y else float(t.y)) for i, t in enumerate(frame.itertuples())], "g string, x int, y double")
    known = rows.toPandas().dropna(subset=["x", "y"])
    want = {k: p.x.rank().corr(p.y.rank()) for k, p in (known.fillna({"g": "-"}).groupby("g") if group else [("-", known)])}
    got = {(t.g if group else None) or "-": t for t in stats.spearman(rows, "x", "y", *group).collect()}
    assert {k: t.rho for k, t in got.items()} == pytest.approx(want, abs=1e-6)
    assert stats.spearman(rows.limit(0), "x", "y", "g").count() == 0


def test_first_rows_of_keys(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, None, 3.0), (4, None, 3.0), (5, "b", None)], "i long, k string, v double")
    assert sorted(map(tuple, corpus.keep_first(rows, F.upper("k"), "i").collect())) == [(1, "a", 1.0), (3, None, 3.0), (4, None, 3.0), (5, "b", None)]


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k_equals_brute_force(spark, block):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8)).round(1)
    x[50:60] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0] * 7), (903, [None] + [1.0] * 7), (904, [float("nan")] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = extraction.top_k(v, v.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5, block).orderBy("query", "place").collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = []
    for q in range(0, 300, 50):
        score = np.round(unit @ unit[q], 6)
        want += [(q, int(i), p + 1) for p, i in enumerate(sorted(range(300), key=lambda i: (-score[i], i))[:5])]
    assert [(g.query, g.vec_id, g.place) for g in got] == want


@pytest.mark.parametrize("kind", ["separated", "dependent"])
def test_logit_without_p_values(spark, kind):
    r = np.random.default_rng(3)
    rows = [(int(i > 50) if kind == "separated" else int(r.random() > 0.5), float(i), 2.0 * i if kind == "dependent" else float(r.random())) for i in range(100)]
    got = stats.logit(spark.createDataFrame(rows, "y int, a double, b double"), "y", ["a", "b"]).collect()
    assert [g.term for g in got] == ["intercept", "a", "b"] and all(g.p_value is None and g.coefficient is not None for g in got)


def test_seen_keys_expire(spark, tmp_path):
    from reprolens.streaming import incremental as inc

    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-03 00:00:00")], "k int, t string").select("k", F.to_timestamp("t").alias("t"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = inc.unseen(inc.read(spark, str(tmp_path / "in"), rows.schema), "k", time="t", late="1 day")
    assert sorted(r.k for r in spark.read.parquet(inc.drain(stream, spark)).collect()) == [1, 2]


def test_greedy_match_equals_plain_fold(spark):
    r = np.random.default_rng(5)
    words = ["alpha", "beta", "alp", "net", "the", "net (AB)", "x", "(--)", "ab", "é"]
    rows = [(int(r.integers(2)), int(r.integers(3)), "m", i, " ".join(r.choice(words, r.integers(1, 4))), str(r.choice(["", "a"]))) for i in r.permutation(240).tolist()]
    items = spark.createDataFrame(rows, "side int, study int, field string, pos int, name string, extra string")
    named = spark.createDataFrame([(n,) for n in sorted({t[4] for t in rows})], "a string")
    like = {tuple(t) for t in named.crossJoin(named.withColumnRenamed("a", "b")).filter(text.names_match(F.col("a"), F.col("b"))).collect()}
    want = {}
    for study in range(3):
        gold, said = (sorted((t[3], t[4], t[5]) for t in rows if t[:2] == (side, study)) for side in (0, 1))
        left = list(said)
        for g in gold:
            left.remove(next((p for p in left if p[2] == g[2] and (g[1], p[1]) in like), None)) if any(p[2] == g[2] and (g[1], p[1]) in like for p in left) else None
        tp = len(said) - len(left)
        want[study] = (tp, len(left), len(gold) - tp)
    got = evaluation.greedy_match(items.filter("side = 0"), items.filter("side = 1")).collect()
    assert {t.study: (t.tp, t.fp, t.fn) for t in got} == want


@pytest.mark.parametrize("fuzzy", [True, False])
def test_greedy_match_of_long_lists(spark, fuzzy):
    """60,000 names on each side of one study and field; a comparison of all pairs never ends."""
    items = spark.range(120_000).select(F.lit(1).alias("study"), F.lit("m").alias("field"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("name "), (F.col("id") % 600).cast("string")).alias("name"))
    got = evaluation.greedy_match(items.filter("pos % 2 = 0"), items.filter("pos % 2 = 1 or pos < 600"), fuzzy).first()
    assert got.tp == 60_000 if fuzzy else got.tp == 300
    assert got.tp + got.fp == 60_300 and got.tp + got.fn == 60_000
