"""Rewritten shards hold every row once, with null and repeated ids too."""

from collections import Counter

from reprolens.llm import resharding


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 7), "x") for i in range(120)] + [(None, f"no id {i}", "x") for i in range(30)] + [(None, None, "y")] * 3
    rows += [(5, f"other {i}", "x") for i in range(20)] + [(6, "same", f"c{i % 2}") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, size string").repartition(3)
    assigned = resharding.assign(spark, frame)
    touched = resharding.rewrite(frame, assigned, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    places = [(r.shard, r.slot) for r in assigned.collect() if r.shard in touched]
    assert sorted((r.shard, r.slot) for r in got) == sorted(places)
    assert touched == list(range(8)) and Counter((r.doc_id, r.text, r["size"]) for r in got) == Counter(rows)
