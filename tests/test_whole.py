"""Queries over whole tables: no row and no part of a text is left out."""

import pytest
from pyspark.sql import functions as F

from reprolens.operators import evaluation
from reprolens.plans import catalog


@pytest.mark.parametrize(("name", "table", "key", "count"), [("compare_entry_status", "orders", None, "n_claims"), ("reference_present", "customer", None, "n"), ("common_fields", "events", "methods", "n")])
def test_whole_tables_are_read(spark, sf, name, table, key, count):
    rows = catalog.QUERIES[name](spark, sf)
    rows = rows.filter(F.col("field") == key) if key else rows
    assert rows.agg(F.sum(count)).first()[0] == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_grounding_equals_pairs(spark, tmp_path):
    names = ["Deep Graph Library (DGL)", "The of", "", None, "one two three four five six seven", "a", "the Of a", "one (TWO) (three four)"]
    texts = ["we use dgl here", "a deep graph model", "the of x", "", None, "one two three", "one two three four five", "library graph; DEEP", "the of a b"]
    a = spark.createDataFrame(list(enumerate(names)), "item_id long, text string")
    b = spark.createDataFrame([(i, t, "de" if i % 2 else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = sorted((r.item_id, r.doc_id) for r in evaluation.grounding(a, b, "item_id", "text", "doc_id", "text").collect())
    pairs = a.withColumnRenamed("text", "name").crossJoin(b).select("item_id", "doc_id", evaluation.name_grounded(F.col("name"), F.col("text")).alias("x")).collect()
    assert got == sorted((r.item_id, r.doc_id) for r in pairs if r.x) and got
    a.write.parquet(f"{tmp_path}/benchmark.parquet")
    b.write.parquet(f"{tmp_path}/documents.parquet")
    counts = {r.item_id: r.n_grounded for r in catalog.QUERIES["ground_tokens"](spark, str(tmp_path)).collect()}
    assert counts == {i: sum(k == i for k, _ in got) for i in range(len(names))}


def test_texts_are_not_cut(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(100))
    spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert catalog.QUERIES["joined_documents"](spark, str(tmp_path)).first().n_chars == 2 * (len(text) + len("## 000\n")) + 2
    spark.createDataFrame([(0, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, text), (1, "word0 word1 word2 word3 word4 word5")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.QUERIES["ground_tokens"](spark, str(tmp_path)).first().n_grounded == 1
