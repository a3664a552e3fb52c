"""String and value functions: golden cases and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reprolens.functions import text as tx
from reprolens.functions import values as vx
from reprolens.operators import outcomes, parsing
from reprolens.operators.extraction import repair_json

C = F.col


def each(spark, values, f, names="a string, b string"):
    n = len(names.split(","))
    data = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    rows = spark.createDataFrame(data, "i int, " + names).select("i", f(*[C(x.split()[0]) for x in names.split(", ")]).alias("x")).orderBy("i").collect()
    assert n
    return [r.x for r in rows]


def test_names_match(spark):
    pairs = [("RTN", "Round-to-nearest (RTN)"), ("CAFR", "Camouflage-Aware Feature Refinement (CAFR)"), ("CIFAR10", "CIFAR-10"), ("VQ-VAE", "Vector Quantized Variational Autoencoder (VQ-VAE)"), ("ImageNet", "GLUE"), ("accuracy", "perplexity"), (None, "x"), ("", "")]
    want = [True, True, True, True, False, False, False, False]
    assert each(spark, pairs, tx.names_match) == want
    assert each(spark, [(b, a) for a, b in pairs], tx.names_match) == want


def test_names_match_without_blanks(spark):
    pairs = [("ResNet 50", "ResNet50 model"), ("Rounding (round to nearest)", "RoundToNearest"), ("Method (A-B)", "ab"), ("x (YZ)", "q (yz)"), ("a b", "ab c d"), ("word2vec", "Word 2 Vec embeddings"), ("map", "roadmap")]
    assert each(spark, pairs, tx.names_match) == [True, False, True, True, False, True, False]
    assert each(spark, ["Deep Net (two words)", "(dn)", "a (B-2)", "x (é)"], lambda a: F.array_sort(tx.acronyms(a)), "a string") == [["dn"], ["dn"], ["b2"], []]


def test_metric_match(spark):
    pairs = [("acc", "accuracy"), ("ap", "map"), ("Top-1 acc", "top-1 accuracy"), ("F1 (macro)", "f1"), ("", "x"), (None, None), ("f-1", "f-1 score")]
    assert each(spark, pairs, outcomes.metric_match) == [True, False, True, True, False, False, True]


def test_numbers(spark):
    assert each(spark, ["10.90", "94%", "1,024", "n/a", "5d", "1e3", None, "", ".5", "-2"], vx.number, "a string") == [10.9, 0.94, 1024.0, None, None, 1000.0, None, None, 0.5, -2.0]
    assert len(set(each(spark, ["0.94", "0.940", "94%"], vx.canonical, "a string"))) == 1


def test_classify_pair(spark):
    pairs = [("10.90", "10.92"), ("0.943", "0.945"), ("70.5", "40.0"), ("94%", "0.94"), ("0", "0.02"), ("a", "A "), ("1", None)]
    assert each(spark, pairs, vx.classify_pair) == ["reproduced", "reproduced", "mismatch", "reproduced", "reproduced", "reproduced", "mismatch"]


def test_slugs(spark):
    assert each(spark, ["Qwen/Qwen2.5-14B-Instruct-GPTQ-Int8", None, "gpt-4o", "a__b//c"], tx.slug, "a string") == ["qwen-qwen2-5-14b-instruct-gptq-int8", "default", "gpt-4o", "a-b-c"]


def test_nullish(spark):
    values = ["exact version not specified", "1.13.1", " N/A ", None]
    assert each(spark, values, lambda a: tx.clean(a, tx.NULLISH_EVALUATION), "a string") == [None, "1.13.1", None, None]
    assert each(spark, values, tx.clean, "a string") == ["exact version not specified", "1.13.1", None, None]


def test_licences(spark):
    texts = ["Permission is hereby granted, free of charge, to", "Apache License\nVersion 2.0", "Redistribution and use ... Neither the name of", "Redistribution and use", "my own", None]
    assert each(spark, texts, parsing.licence, "a string") == ["MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "LicenseRef-Custom", None]


def test_versions(spark):
    assert each(spark, ["3.7", "3.6", "3.10", "3.11", "3.13", "3.9", "x"], parsing.nearest_version, "a string") == ["3.8", "3.8", "3.10", "3.11", "3.12", "3.9", None]
    specs = [">=3.10,<3.11", ">=3.8", ">=3.7,<3.10", "<3.11,>=3.10", "==3.8", ">=3.13"]
    assert each(spark, specs, parsing.highest_version, "a string") == ["3.10", "3.12", "3.9", "3.10", "3.8", None]


def test_dockerfile(spark):
    texts = ["FROM x@sha256:9f2eabc123 AS base", "FROM x:2.1.0-cuda12.1-cudnn8", "FROM a\nENV CUDA_VERSION=11.8\n", "FROM python:3.8-slim", "RUN x"]
    got = each(spark, texts, parsing.dockerfile, "a string")
    assert [r.digest for r in got] == ["sha256:9f2eabc123", None, None, None, None]
    assert [r.cuda for r in got] == [None, "12.1", "11.8", None, None]
    assert got[3].python == "3.8" and got[4].image is None


def test_requirements(spark):
    lines = ["torch==1.13.1", "scikit-learn>=1.0,<2", "# x", "", "-e .", "x; python_version<'3.8'", "pkg[extra]~=2.1", "y @ https://a/b.whl", None]
    got = each(spark, lines, parsing.requirement, "a string")
    assert [r and (r.name, r.version, r.kind) for r in got] == [("torch", "1.13.1", "pinned"), ("scikit_learn", "1.0", "bounded"), None, None, None, ("x", "unspecified", "free"), ("pkg", "2.1", "bounded"), ("y", "unspecified", "url"), None]


def test_failures(spark):
    logs = ["MUJOCO and no module named 'x'", "ModuleNotFoundError: No module named 'a.b'", "CUDA out of memory", "403 for download", "403", "ok"]
    assert each(spark, logs, outcomes.classify_failure, "a string") == ["missing_system_dep:mujoco", "missing_dependency:a.b", "gpu_oom", "gated_download:403", "run_error:other", "run_error:other"]
    assert each(spark, ["skip: api", "gpu_oom", None, "own words"], outcomes.family, "a string") == ["external device/API", "GPU out of memory", "-", "own words"]


def test_last_number(spark):
    got = each(spark, [("acc: 0.5\nacc = 0.91 done", "Acc"), ("loss 1", "acc"), ("a+b 3", "(x)"), ("top-1 -3.5", "top")], outcomes.last_number_near)
    assert got[0] == "0.91" and got[1] is None and got[2] is None


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {"a": {"b": "}"}} ok', '{"a": {"b": "}"}}'), ('{"a": [1, 2', '{"a": [1, 2]}'), ("", "{}"), ("prose only", "{}"), (None, "{}"), ('{"a": "x', '{"a": "x"}')],
)
def test_json_repair(text, want):
    assert repair_json(text) == want


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_json_repair_never_fails(text):
    assert repair_json(text).startswith("{")
