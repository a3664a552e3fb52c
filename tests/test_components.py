"""Connected components against union and find, with ids of any kind."""

import random

import pytest
from pyspark.sql import functions as F

from reprolens.operators.components import connected
from reprolens.sources.staging import Stage


def brute(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in parent if root(x) != x}


@pytest.mark.parametrize("parts", [1, 7])
def test_ids_graphs_and_structs(spark, parts):
    r = random.Random(parts)
    links = [(g, r.randrange(-200, 200) * 2**50, r.randrange(-200, 200) * 2**50) for g in (1, 2, 3) for _ in range(150)] + [(9, i, i + 1) for i in range(400)]
    rows = spark.createDataFrame([*links, (1, None, 4)], "g int, a long, b long").repartition(parts)
    got = {(x.g, x.id): x.component for x in connected(Stage(spark, "c"), rows, "c", "g").collect()}
    assert got == {(g, x): y for g in (1, 2, 3, 9) for x, y in brute([(a, b) for h, a, b in links if h == g]).items()}
    alone = {x.id: x.component for x in connected(Stage(spark, "c"), rows.filter("g = 1").select("a", "b")).collect()}
    assert alone == {x: y for (g, x), y in got.items() if g == 1}
    named = rows.filter("g in (2, 9) and a is not null").select(F.struct(F.col("g").alias("doc"), F.col("a").alias("start")).alias("a"), F.struct(F.col("g").alias("doc"), F.col("b").alias("start")).alias("b"))
    assert {tuple(x.id): tuple(x.component) for x in connected(Stage(spark, "c"), named).collect()} == {(g, x): (g, y) for (g, x), y in got.items() if g in (2, 9)}
    texts = rows.filter("g = 9").select(F.format_string("%05d", "a").alias("a"), F.format_string("%05d", "b").alias("b"))
    assert {x.component for x in connected(Stage(spark, "c"), texts).collect()} == {"00000"}
    assert connected(Stage(spark, "c"), rows.limit(0), "c", "g").count() == 0
