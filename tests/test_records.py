"""Turtle, YAML, models behind interfaces, and sinks that the queries don't reach."""

import pytest
from pyspark.sql import functions as F

from reprolens.functions import text as tx
from reprolens.operators import corpus, extraction, shapes
from reprolens.sources import records, turtle


def test_turtle_documents():
    text = '''@prefix sh: <http://www.w3.org/ns/shacl#> . # note
    PREFIX ex: <http://e.x/>
    ex:S a sh:NodeShape ; sh:property [ sh:path ex:p ; sh:minCount 1 ] , [ sh:path ex:q; ] ;
      ex:said "a \\"b\\"\\n\\u00e9"@en-GB , """long "one"
    two""", 'x'^^<http://www.w3.org/2001/XMLSchema#date> , -1.5e3, 2.5 , true .
    _:n ex:list ( 1 ex:two ) . <http://e.x/a#b> ex:p <> .'''
    got = turtle.triples(text, "k")
    assert ("ex:S", "rdf:type", "sh:NodeShape", "iri", None) in got and ("_:kb0", "sh:path", "ex:p", "iri", None) in got and ("_:kb1", "sh:path", "ex:q", "iri", None) in got
    assert ("ex:S", "ex:said", 'a "b"\né', "literal", "rdf:langString@en-GB") in got and ("ex:S", "ex:said", 'long "one"\n    two', "literal", "xsd:string") in got
    assert ("ex:S", "ex:said", "x", "literal", "xsd:date") in got and ("ex:S", "ex:said", "-1.5e3", "literal", "xsd:double") in got and ("ex:S", "ex:said", "true", "literal", "xsd:boolean") in got
    assert ("_:kb2", "rdf:first", "1", "literal", "xsd:integer") in got and ("_:kb3", "rdf:rest", "rdf:nil", "iri", None) in got and ("_:kn", "ex:list", "_:kb2", "iri", None) in got
    assert turtle.triples("") == []
    with pytest.raises(ValueError):
        turtle.triples("ex:a ex:b")


def test_turtle_of_any_text(spark, tmp_path):
    rows = [("g/1", "a b", "title", 'quo"te\\ \n\t é', "literal", "xsd:string"), ("g/1", "https://x.y/z", "rdf:type", "_:n1", "iri", None), ("h", "s", "p", "", "literal", None), ("h", "s", "p", "ja", "literal", "rdf:langString@de")]
    rows = [(g, s.replace(" ", "%20"), *rest) for g, s, *rest in rows]
    q = spark.createDataFrame(rows, "graph string, s string, p string, o string, o_kind string, o_type string")
    turtle.write(q, str(tmp_path / "t"))
    back = {tuple(r) for r in turtle.read(spark, str(tmp_path / "t")).collect()}
    names = {tuple("xsd:string" if i == 5 and r[4] == "literal" and v is None else v for i, v in enumerate(r)) for r in rows}
    assert {r[:3] + r[4:] for r in back} == {r[:3] + r[4:] for r in names} and {r[3] for r in back if not r[3].startswith("_:")} == {r[3] for r in names if not r[3].startswith("_:")}


def test_shape_files_give_the_constraints(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(shapes.to_turtle())
    got = sorted(map(tuple, shapes.from_turtle(spark, str(tmp_path / "*.ttl")).collect()), key=str)
    assert got == sorted(shapes.CONSTRAINTS, key=str) and len(got) == 33


def test_yaml_sections(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "m.yaml").write_text("high:\n- study: a\n  n: 3\n  tags: [x, y]\nlow:\n- study: b\n  n: many\n")
    rows = records.yaml_lists(spark, str(tmp_path / "m.yaml"), "study string, n int, tags array<string>", "high", "low", "none").collect()
    assert [tuple(r) for r in rows] == [("high", "a", 3, ["x", "y"]), ("low", "b", None, None)]


def test_models_behind_interfaces(spark):
    rows = spark.createDataFrame([(1, "doc a", "p" * 5000, "loss 1\nacc 0.9"), (2, None, None, None), (3, "fail", "", "x")], "k int, text string, paper string, log string")

    def make():
        def client(prompt):
            if "fail" in prompt:
                raise ValueError(prompt)
            return 'Sure: ```json\n{"run_command": "python a.py ' + str(prompt.count("p" * 4000)) + '", "setup_steps": "make"}\n```'

        return client

    got = {r.k: r.recipe for r in extraction.recipes(rows, "text", "paper", make).collect()}
    assert got[1].run_command == "python a.py 1" and got[1].setup_steps == ["make"] and got[3].run_command is None and got[3].confidence == "low"
    answer = '{"obtained": [{"metric": "acc", "value": "0.9", "split": null}, {"metric": "f1", "value": ""}]}'
    found = {r.k: [m.metric for m in r.obtained] for r in extraction.log_metrics(rows, "log", F.array(F.lit("acc")), lambda: lambda p: answer if "acc 0.9" in p else "none").collect()}
    assert found == {1: ["acc"], 2: [], 3: []}


def test_embedding_hook_and_index(spark, tmp_path):
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(["red apple pie", "red apple tart", "blue sky", None])], "study int, pos int, chunk string")
    records.write_index(extraction.embed(rows, "chunk", extraction.hashed_words(32)), str(tmp_path / "index"))
    index = records.read_index(spark, str(tmp_path / "index"))
    assert index.schema["embedding"].dataType.simpleString() == "array<float>" and all(len(r.embedding) == 32 for r in index.collect())
    top = extraction.top_k(index, index.filter("study = 0"), "study", "embedding", 2).orderBy("place").collect()
    assert [r.study for r in top] == [0, 1]


def test_labels(spark):
    rows = spark.createDataFrame([("Org/Qwen2", 1, 8), (None, 0, 0), ("some-own-model-x", 3, 3)], "a string, n int, d int")
    got = rows.select(tx.model_label(F.col("a")).alias("l"), tx.percent(F.col("n"), F.col("d")).alias("p")).collect()
    assert [(r.l, r.p) for r in got] == [("qwen", "12.5%"), ("", "—"), ("some-own-mod", "100.0%")]


def test_long_chains_of_ties(spark):
    rows = spark.createDataFrame([(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(300)], "i long, a string, b string")
    assert corpus.ties(rows, "a", "b", "i").select("_group").distinct().count() == 1


def test_cached_copies(spark, tmp_path):
    path = str(tmp_path / "ontology.ttl")

    def fails():
        raise OSError("no network")

    with pytest.raises(OSError):
        records.refresh(spark, path, fails)
    assert records.refresh(spark, path, lambda: (b"one", "1.2")) and not records.refresh(spark, path, lambda: (b"one", "1.2")) and not records.refresh(spark, path, fails)
    assert records.refresh(spark, path, lambda: (b"one", "1.10")) and records.refresh(spark, path, lambda: (b"two", "1.10")) and (tmp_path / "ontology.ttl").read_bytes() == b"two"
