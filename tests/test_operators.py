"""Operators on small tables: golden cases and brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reprolens.operators import corpus, diff, evaluation, extraction, graph, outcomes, parsing, scoring, shapes, stats
from reprolens.sources import records

C = F.col


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_conflicts(spark):
    dep = "pair int, name string, version string"
    a = table(spark, dep, (1, "torch", "1.12.0"), (1, "scikit-learn", "1.0"), (1, "x", "unspecified"), (1, "same", "2"))
    b = table(spark, dep, (1, "torch", "2.0.0"), (1, "scikit_learn", "1.1"), (1, "x", "3"), (1, "same", "2"), (2, "torch", "9"))
    assert {(r.name, r.original_value, r.reproduction_value) for r in diff.version_conflicts(a, b).collect()} == {("torch", "1.12.0", "2.0.0"), ("scikit_learn", "1.0", "1.1")}
    d = "pair int, digest string"
    got = diff.digest_conflicts(table(spark, d, (1, "aa"), (2, "bb"), (3, "")), table(spark, d, (2, "bb"), (2, "cc"))).collect()
    assert {(r.pair, r.reproduction_value) for r in got} == {(1, "absent"), (2, "cc")}
    v = "pair int, name string, value string"
    got = diff.seed_conflicts(table(spark, v, (1, "seed", "42"), (1, "s2", "1")), table(spark, v, (1, "seed", "123"))).collect()
    assert {(r.name, r.reproduction_value) for r in got} == {("seed", "123"), ("s2", "absent")}
    p = "pair int, prop string, value string"
    got = diff.hardware_conflicts(table(spark, p, (1, "cuda", "11.6"), (1, "os", "u"), (1, "gpu", "A")), table(spark, p, (1, "cuda", "12.1"), (1, "os", "u"))).collect()
    assert {(r.prop, r.severity) for r in got} == {("cuda", "HIGH"), ("gpu", "MEDIUM")}


def quad(s, p, o, graph_name="g", kind="literal", of="xsd:string"):
    return (graph_name, s, p, o, kind, of)


def complete(spark):
    return table(
        spark, graph.SCHEMA,
        quad("a", "identifier", "x"), quad("a", "title", "t"), quad("a", "dataLicense", "MIT"), quad("a", "usedMethod", "m", kind="iri"), quad("s", "softwareLicense", "MIT"), quad("s", "commitHash", "1"), quad("e", "rdf:type", "EnvironmentSpec", kind="iri"), quad("a", "generatesDataset", "d", kind="iri"),
    )


def test_weights_and_scores(spark):
    most = {(c.dimension, c.name): m for c, m in scoring.weights()}
    assert most["Findable", "Persistent identifier"] == 5.0 and most["Reproducible", "Environment"] == 12.0 and most["Reusable", "Software licence"] == 7.5
    grades = scoring.grade(complete(spark))
    points = {r.criterion: r.points for r in grades.collect()}
    assert points["Persistent identifier"] == 2.5 and points["Software licence"] == 7.5 and points["Environment"] == 6.0
    total = scoring.totals(grades).first()
    assert total.tier == "poor" and total.total_score == pytest.approx(2.5 + 5 + 5.62 + 6.67 + 12.5 + 6 + 4.5 + 4.5, abs=0.02)
    first = scoring.recommendations(grades).orderBy("place").first()
    assert first.priority == "essential"


def test_shapes(spark):
    q = table(spark, graph.SCHEMA, quad("a", "rdf:type", "ResearchActivity", kind="iri", of=None), quad("a", "identifier", "x"), quad("s", "rdf:type", "SoftwareApplication", kind="iri", of=None), quad("s", "commitHash", "1"), quad("d", "rdf:type", "SoftwareDependency", kind="iri", of=None), quad("d", "dependencyVersion", "unspecified"), quad("d", "dependencyName", "n", of="xsd:integer"))
    got = {(r.focus, r.path, r.problem) for r in shapes.validate(q, shapes.constraints(spark)).collect()}
    assert {("s", "softwareLicense", "min_count"), ("a", "rdfs:label", "min_count"), ("d", "dependencyVersion", "not_value"), ("d", "dependencyName", "datatype")} <= got
    assert ("s", "commitHash", "min_count") not in got
    assert not shapes.conformance(q, shapes.constraints(spark)).first().conforms


def test_artifacts(spark):
    paths = ["requirements.txt", "requirements-dev.txt", "docker/docs/Dockerfile", "docker/runtime/Dockerfile", ".git/setup.py", "node_modules/x/setup.py", "a/b/c/d/e/setup.py", "notes.md"]
    ranked = parsing.artifacts(table(spark, "repo int, path string", *[(1, p) for p in paths]))
    best = {r.type: r.path for r in ranked.filter("place = 1").collect()}
    assert best == {"pip": "requirements.txt", "docker": "docker/runtime/Dockerfile"}
    assert parsing.primary(ranked).first().path == "docker/runtime/Dockerfile"


def test_greedy_match(spark):
    e = "study int, field string, pos int, name string"
    gold = table(spark, e, (1, "m", 0, "Round-to-nearest (RTN)"), (1, "m", 1, "RTN"), (2, "m", 0, "x"), (3, "m", 0, None))
    said = table(spark, e, (1, "m", 0, "RTN"), (4, "m", 0, "y"))
    got = {r.study: (r.tp, r.fp, r.fn) for r in evaluation.greedy_match(gold, said).collect()}
    assert got == {1: (1, 0, 1), 2: (0, 0, 1), 4: (0, 1, 0)}
    exact = {r.study: (r.tp, r.fp, r.fn) for r in evaluation.greedy_match(gold.filter("pos = 0"), said, fuzzy=False).collect()}
    assert exact[1] == (0, 1, 1)


def test_greedy_match_of_values_and_slots(spark):
    e = "study int, field string, pos int, name string, extra string, value string"
    gold = table(spark, e, (1, "evaluation_results", 0, "acc", "", "94%"), (1, "parameters", 0, "lr", "", "0.1"), (1, "environment", 0, "A100", "gpu_model", None), (1, "environment", 1, "11.8", "cuda_version", None))
    said = table(spark, e, (1, "evaluation_results", 0, "acc", "", "0.5"), (1, "evaluation_results", 1, "acc", "", "0.940"), (1, "parameters", 0, "lr", "", "0.2"), (1, "environment", 0, "A100", "gpu_model", None), (1, "environment", 1, "12.1", "cuda_version", None))
    got = {r.field: (r.tp, r.fp, r.fn) for r in evaluation.greedy_match(gold, said).collect()}
    assert got == {"evaluation_results": (1, 1, 0), "parameters": (1, 0, 0), "environment": (1, 1, 1)}
    assert {r.field: r.tp for r in evaluation.greedy_match(gold, said, strict=True).collect()}["parameters"] == 0


def test_common_fields(spark):
    kinds = "struct<SoftwareApplication:array<struct<name:string,version:string>>,Dataset:array<struct<name:string>>,Method:array<struct<name:string>>,Parameter:array<struct<name:string,value:string>>,RandomSeed:array<struct<value:string>>,EvaluationResult:array<struct<metric:string,value:string,split:string>>,ComputingEnvironment:array<struct<gpu:string,cuda:string>>>"
    gold = table(spark, f"study_id string, entities {kinds}", ("s", ([("torch", "not specified")], [("unknown",)], [], [("lr", "0.1")], [("42",)], [("acc", "0.9", "test")], [("modern gpus", "11.8"), ("A100", None)])), ("t", ([], None, [], [], [], [], [])))
    rows = sorted((r.field, r.name, r.extra, r.value) for r in evaluation.gold_fields(gold).collect())
    assert rows == [("environment", "11.8", "cuda_version", None), ("evaluation_results", "acc", "", "0.9"), ("parameters", "lr", "", "0.1"), ("random_seeds", "42", "", None), ("software", "torch", "", None)]


def test_points_are_whole(spark):
    import random

    units = [int(round(m * 24)) for _, m in scoring.weights()]
    assert [u / 24 for u in units] == pytest.approx([m for _, m in scoring.weights()])
    grades = scoring.grade(complete(spark))
    rows, seen = grades.collect(), set()
    for seed in range(12):
        random.Random(seed).shuffle(rows)
        seen |= {tuple(r) for r in scoring.totals(spark.createDataFrame(rows, grades.schema).repartition(seed % 4 + 1)).collect()}
    assert len(seen) == 1


def test_prf(spark):
    r = evaluation.prf(table(spark, "k int, tp int, fp int, fn int", (1, 8, 2, 2)), "k").first()
    assert (r.precision, r.recall, r.f1, r.support) == (0.8, 0.8, 0.8, 10)


def test_compare(spark):
    s = "study int, pos int, metric string, value string, split string"
    claims = table(spark, s, (1, 0, "acc", ".90", None), (1, 1, "F1", ".80", None), (2, 0, "acc", ".9", None), (3, 0, "acc", ".9", "test"))
    got = table(spark, s, (1, 0, "acc", ".91", None), (1, 1, "F1", ".40", None), (2, 0, "acc", ".10", None))
    assert {r.study: r.status for r in outcomes.status(outcomes.compare(claims, got)).collect()} == {1: "partial", 2: "mismatch", 3: "run_failed"}


def test_bands(spark):
    rows = lambda *x: table(spark, "b int, v double", *x)
    one = lambda *x: stats.concordance(rows(*x), "b", "v").first().concordance
    assert one((1, 80.0), (1, 70.0), (0, 30.0), (0, 20.0)) == 1.0
    assert one((1, 20.0), (0, 80.0)) == 0.0 and one((1, 5.0), (0, 5.0)) == 0.5 and one((1, 5.0)) is None
    bands = table(spark, "b string, v double", ("high", 70.0), ("high", 80.0), ("low", 30.0), ("low", 55.0))
    assert stats.separation(bands, "b", "v", "high", "low").first()[0] == 15.0


def test_concordance_equals_pairs(spark):
    r = np.random.default_rng(0)
    data = [(int(b), float(v)) for b, v in zip(r.integers(0, 4, 200), r.integers(0, 30, 200), strict=True)]
    pairs = [1.0 if v > w else 0.5 if v == w else 0.0 for b, v in data for c, w in data if b > c]
    got = stats.concordance(table(spark, "b int, v double", *data), "b", "v").first()
    assert got.n_pairs == len(pairs) and got.concordance == pytest.approx(np.mean(pairs), abs=1e-6)


def test_logit_equals_newton(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 2))
    y = (r.random(400) < 1 / (1 + np.exp(-(0.5 + x[:, 0] - 2 * x[:, 1])))).astype(int)
    got = {t.term: t.coefficient for t in stats.logit(table(spark, "y int, a double, b double, c double", *[(int(t), float(p), float(q), 1.0) for t, (p, q) in zip(y, x, strict=True)]), "y", ["a", "b", "c"]).collect()}
    m, w = np.column_stack([np.ones(400), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-m @ w))
        w += np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m, m.T @ (y - p))
    assert "c" not in got and [got["intercept"], got["a"], got["b"]] == pytest.approx(list(w), abs=1e-4)


@given(st.lists(st.tuples(st.sampled_from([None, "a", "b", "c", "d"]), st.sampled_from([None, "x", "y", "z"])), max_size=14))
@settings(max_examples=8, deadline=None)
def test_two_key_dedup_equals_fold(spark, pairs):
    first, second, want = set(), set(), []
    for i, (a, b) in enumerate(pairs):
        if (a is None or a not in first) and (b is None or b not in second):
            want.append(i)
            first.add(a)
            second.add(b)
    rows = table(spark, "i long, a string, b string", *[(i, a, b) for i, (a, b) in enumerate(pairs)])
    assert sorted(r.i for r in corpus.keep_first_two_keys(rows, "a", "b", "i").collect()) == want


def test_quota(spark):
    rows = table(spark, "id int, points int", *[(i, 9 if i < 40 else 1) for i in range(150)])
    got = corpus.quota(rows, "points", "id").groupBy("final_tier").count().collect()
    assert {r.final_tier: r["count"] for r in got} == {"full": 30, "build_only": 70}
    kept = {r.id for r in corpus.quota(rows, "points", "id").collect()}
    assert set(range(40)) <= kept  # the ten beyond the full quota come first among the others


def test_merge_first_wins(spark):
    e = table(spark, "study int, pos int, name string, version string", (1, 0, "torch", "2.0"), (1, 1, "Torch", "2.1"), (1, 2, None, "x"))
    got = extraction.first_wins(e, "study", F.lower("name"), C("version"), "pos").collect()
    assert [(r.key, r.value) for r in got] == [("torch", "2.0")]


def test_chunks(spark):
    words = [f"w{i}" for i in range(429)]
    got = extraction.chunks(table(spark, "k int, t string", (1, " ".join(words)), (2, ""), (3, None), (4, " ".join(words[:29])), (5, " ".join(words[:30]))), "k", "t").orderBy("k", "pos").collect()
    assert [(r.k, r.pos, r.n_words) for r in got] == [(1, 0, 200), (1, 1, 200), (1, 2, 79), (5, 0, 30)]


def test_extract_with_stub(spark):
    got = extraction.extract(table(spark, "k int, t string", (1, "a b"), (2, "")), "t", "n long", lambda: lambda t: {"n": len(t)} if t else {}).orderBy("k").collect()
    assert [r.n for r in got] == [3, None]


def test_nquads_round_trip(spark, tmp_path):
    q = table(spark, graph.SCHEMA, ("g", "s", "p", 'a "b"\n\\ c', "literal", "xsd:string"), ("g", "s", "q", "o", "iri", None), ("h", "s", "p", "", "literal", None))
    records.to_nquads(q).write.text(str(tmp_path / "q"))
    back = records.from_nquads(spark.read.text(str(tmp_path / "q")))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, q.collect()), key=str)


def test_graph_store(spark, tmp_path):
    store = records.GraphStore(spark, str(tmp_path / "store"))
    row = lambda g, o: table(spark, graph.SCHEMA, (g, "s", "p", o, "literal", None))
    store.put(row("g", "1").union(row("h", "1")))
    store.append(row("g", "1"))
    store.append(row("g", "2"))
    store.put(row("h", "9"))
    assert sorted((r.graph, r.o) for r in store.read().collect()) == [("g", "1"), ("g", "2"), ("h", "9")]
    store.delete("g")
    assert [(r.graph, r.o) for r in records.GraphStore(spark, str(tmp_path / "store")).read().collect()] == [("h", "9")]


def test_json_documents_and_flattening(spark, tmp_path):
    (tmp_path / "study001__m-1.json").write_text('{"study_id": "study001", "status": "ok", "build": {"attempted": true, "build_success": null}, "artifacts": {"by_type": {"pip": "requirements.txt"}}}')
    (tmp_path / "study002.json").write_text('{"study_id": "study002"}')
    (tmp_path / "z.json").write_text('{"study_id": "study002", "status": "second"}')
    (tmp_path / "bad.json").write_text("{oops")
    rows = records.json_documents(spark, str(tmp_path / "*.json"), records.RESULT, "study_id")
    got = {r.study_id: r for r in records.flatten_results(rows).collect()}
    assert set(got) == {"study001", "study002"} and got["study001"].has_pip and not got["study002"].has_pip and got["study002"].status is None
    assert got["study001"].attempted and got["study001"].built is None
    keys = rows.select(*[k.alias(n) for k, n in zip(records.key_and_slug(C("file_name")), "ab", strict=True)]).collect()
    assert ("study001", "m-1") in {tuple(k) for k in keys}
    assert records.predictors(records.flatten_results(rows)).count() == 2


def test_newer():
    assert records.newer(b"x", None, None, None) and records.newer(b"x", "0", "1.2", "1.10") and not records.newer(b"", records.hashlib.sha256(b"").hexdigest(), "1.2", "1.10")
