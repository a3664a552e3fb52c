"""The pipeline on odd documents: null and repeated ids, clashing columns, no rows."""

import random

import corpus_pipeline as p
from reprolens.llm import quality

CLASH = "doc_id long, text string, lang string, source string, n_chars long, _copies int, row string, size int, copy string, x string, n int, id string, spans string, component_id long"


def folder(spark, path, rows):
    filled = [(*r, 1, "r", 2, "c", "x", 3, "i", "s", 4) for r in rows]
    spark.createDataFrame(filled, CLASH).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int("good" in r[1]), 0) for r in rows if r[0] is not None and r[1]] + [(None, 1, 0), (10**6, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def some(seed=4):
    r = random.Random(seed)
    good = lambda: "good " + " ".join(r.choice(["the", "of", "plain", "words", "and", "text", "fine", "calm"]) + r.choice(["", "", ".", ","]) for _ in range(r.randint(30, 90)))
    bad = lambda: "bad " + " | ".join(r.choice(["MENU", "x9", "!!"]) for _ in range(r.randint(30, 90)))
    rows = [(i, good() if i % 3 else bad(), "en", ["a", "b", None][i % 3 - 1 if i % 2 else 0], 5) for i in range(150)]
    copy = good()
    rows += [(200, copy, "en", "a", 1), (201, copy, "en", "a", 1), (202, copy + " more", "en", "b", 1)]
    rows += [(None, good(), "en", "a", 1), (None, bad(), "en", None, 1), (None, None, None, None, None), (5, rows[5][1], "en", "a", 5), (7, "", "en", "a", 0), (300, "good " * 20_000, "en", "b", 0)]
    return rows


def test_odd_documents(spark, tmp_path):
    sf = folder(spark, tmp_path, some())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.STAGES[0][1](spark, docs, sf)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sum(t.startswith("bad") for t in texts) <= 3 and sum(t.startswith("good") for t in texts) >= 95
    packed = p.run(spark, sf)
    got = packed.toPandas()
    assert len(got) and got.groupby("sequence_id").length.sum().max() <= 2048
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_no_documents(spark, tmp_path):
    sf = folder(spark, tmp_path, some()[:0] + [(1, "good x", "en", "a", 1)])
    empty = str(tmp_path / "empty")
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert p.run(spark, empty).count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    rows = some()
    docs = spark.createDataFrame([r[:5] for r in rows] + [(1, rows[0][1], "en", "a", 1), (None, rows[3][1], "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], int("good" in r[1])) for r in rows if r[0] is not None and r[1]], "doc_id long, quality int")
    kept = [(r.doc_id, r.text) for r in quality.keep_good(spark, docs, labels).collect()]
    assert (1, rows[1][1]) in kept and (1, rows[0][1]) not in kept and not any(t and t.startswith("bad") for i, t in kept if i is None)
