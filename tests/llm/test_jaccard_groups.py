"""Groups of the Jaccard join that only long lists of single tokens hold together."""

import random

import numpy as np
from pyspark.sql import functions as F

from reprolens.llm import common, jaccard


def test_prefixes_take_chains_apart_before_sets_become_rows(spark):
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passages = [words(40) for _ in range(12)]
    texts = [" ".join(passages[i // 40] + passages[i // 40 + 1] + words(60)) for i in range(400)]  # 40 or 80 documents have a passage
    twin = " ".join(texts[7].split()[:-1] + ["end"])
    copies = [" ".join(texts[0].split()[:-1] + [f"end{i}"]) for i in range(70)]
    sets = jaccard.shingles([t.encode() for t in [*texts, twin, *copies]])
    known = jaccard.shingles([" ".join(w for p in passages for w in p).encode()])[0].view(np.int64)
    rows = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "doc long, tokens binary")
    groups = spark.createDataFrame([(i, 0, 0) for i in range(len(sets))], "doc long, g0 long, g1 long")
    stage = common.Stage(spark, "untie")
    pairs, again = jaccard.untie(stage, groups, rows, np.stack([known, np.full(len(known), 40)]), 85)
    assert sorted(x.doc for x in again.collect()) == [0, *range(401, 471)]
    assert (7, 400) in {(p.x, p.y) for p in pairs.collect()}
    made = stage.read("prefixes").groupBy("doc").count().agg(F.sum("count")).first()[0]
    assert made == sum(jaccard.prefix(len(s)) for s in sets) < sum(map(len, sets)) / 5


def test_long_lists_report_their_lengths():
    import pyarrow as pa

    n = [40, 200, 5]
    token = np.repeat([3, 5, 9], n)
    frame = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(token), np.int32)), pa.array(token), *[pa.array(np.arange(len(token)) + 1)] * 2, pa.array(np.zeros(len(token), np.int64))], names=["kind", "token", "doc", "size", "heavy"])
    for cut in (len(token), 30, 7):
        told = {}
        for b in jaccard._lists(85)(frame.slice(at, cut) for at in range(0, len(token), cut)):
            for kind, x, y in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == 4:
                    told[x] = told.get(x, 0) + y
        assert told == {3: 40, 5: 200}
