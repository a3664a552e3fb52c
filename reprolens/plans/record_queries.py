"""Queries over sources and sinks: records are written to the shared folder, read back and counted; with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprolens.functions import text as tx
from reprolens.operators import corpus, evaluation, extraction, parsing, shapes
from reprolens.plans.graph_queries import QUADS, quads
from reprolens.sources import records, turtle
from reprolens.sources.tables import table
from reprolens.streaming.incremental import place

C, L = F.col, F.lit


def s(x):
    return x.cast("string")


# --- files ------------------------------------------------------------------------------------------


def _documents(spark, sf):
    """A JSON file for each nation, some of two models, two of them broken, one with another's key."""
    root = place(spark, "json")
    for r in table(spark, sf, "nation").collect():  # a fixed table
        name = f"study{r.n_nationkey:03d}" + (f"__model-{r.n_regionkey}" if r.n_nationkey % 2 else "")
        text = f'{{"study_id": "study{r.n_nationkey:03d}", "status": "{r.n_name}", "duration_s": {r.n_regionkey}.5}}' if r.n_nationkey % 10 != 3 else "{oops"
        records.write_lines(spark, f"{root}/{name}.json", [text])
    records.write_lines(spark, f"{root}/zz.json", ['{"study_id": "study000", "status": "second"}'])
    return root


def json_documents(spark, sf):
    rows = records.json_documents(spark, _documents(spark, sf) + "/*.json", records.RESULT, "study_id")
    return rows.select("study_id", "status", "duration_s")


def json_key_and_slug(spark, sf):
    rows = records.json_documents(spark, _documents(spark, sf) + "/study*.json", records.RESULT)
    key, slug = records.key_and_slug(C("file_name"))
    return rows.select(key.alias("study"), slug.alias("slug"), "status")


def folder_scan(spark, sf):
    root = place(spark, "folder")
    for r in table(spark, sf, "nation").collect():  # a fixed table
        records.write_lines(spark, f"{root}/{'d/' * (r.n_nationkey % 4)}{r.n_nationkey}.txt", [r.n_name])
    return records.files(spark, root, "*.txt").select("rel_path", C("depth").cast("long").alias("depth"), "length")


def disk_usage(spark, sf):
    root = place(spark, "usage")
    for r in table(spark, sf, "region").collect():  # a fixed table
        records.write_lines(spark, f"{root}/{r.r_regionkey}/x.txt", [r.r_name * 3])
    return records.disk_usage(records.files(spark, root))


def text_files(spark, sf):
    root = place(spark, "texts")
    for r in table(spark, sf, "nation").collect():  # a fixed table
        records.write_lines(spark, f"{root}/{r.n_nationkey}.md", [r.n_name, "second line"])
    return records.whole_text(spark, root + "/*.md", 12)


def json_by_key(spark, sf):
    path = place(spark, "by-key")
    records.write_json(table(spark, sf, "customer").select("c_mktsegment", "c_custkey"), path, "c_mktsegment")
    return spark.read.schema("c_custkey long, c_mktsegment string").json(path).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


def _report(spark, sf):
    path = place(spark, "csv")
    rows = table(spark, sf, "region").select("r_regionkey", F.concat(C("r_name"), L(', "x"')).alias("title"), F.array(L("a"), C("r_name")).alias("tags"))
    records.write_csv(rows, path)
    return path


def csv_report(spark, sf):
    return records.csv_rows(spark, _report(spark, sf), "r_regionkey int, title string, tags string")


def csv_first_fields(spark, sf):
    return records.csv_head(spark, _report(spark, sf), "key", "title")


def yaml_manifest(spark, sf):
    path = place(spark, "yaml") + "/manifest.yaml"
    records.write_yaml(table(spark, sf, "nation").select(C("n_name").alias("study"), C("n_regionkey").alias("claims"), F.when(C("n_nationkey") % 3 == 0, L("skipped: x")).alias("status")), path)
    return corpus.selected(records.yaml_lists(spark, path, "study string, claims int, status string"), "status", "skipped: x").select("study", "claims")


def reports(spark, sf):
    """The lines of a small result as Markdown, text and LaTeX."""
    root, rows = place(spark, "report"), table(spark, sf, "region").orderBy("r_regionkey").select("r_regionkey", F.concat(C("r_name"), L("_&|x")).alias("name"))
    records.write_markdown(rows, f"{root}/a.md", "Regions")
    records.write_text(rows, f"{root}/b.txt", "Regions")
    records.write_latex(rows, f"{root}/c.tex", "Regions")
    return spark.read.text(root).select(F.substring("value", 1, 40).alias("line")).filter(C("line").contains("AFRICA"))


def turtle_round_trip(spark, sf):
    path = place(spark, "turtle")
    turtle.write(quads(spark, sf), path)
    return turtle.read(spark, path)


def shape_files(spark, sf):
    root = place(spark, "shapes")
    half = len(shapes.CONSTRAINTS) // 2
    cut = next(i for i in range(half, len(shapes.CONSTRAINTS)) if shapes.CONSTRAINTS[i][0] != shapes.CONSTRAINTS[i - 1][0])
    for name, rows in (("a", shapes.CONSTRAINTS[:cut]), ("b", shapes.CONSTRAINTS[cut:])):
        records.write_lines(spark, f"{root}/{name}.ttl", [shapes.to_turtle(rows)])
    return shapes.from_turtle(spark, f"{root}/*.ttl")


def _results(spark, sf):
    """Suppliers as result documents, written as JSON lines."""
    path, k = place(spark, "results"), C("s_suppkey")
    build = F.struct((k % 3 != 0).alias("attempted"), F.when(k % 3 == 1, k % 2 == 0).alias("resolve_success"), F.when(k % 6 == 1, L(True)).alias("build_success"), F.when(k % 3 == 2, L("resolve")).alias("stage_failed"))
    kinds = F.map_filter(F.create_map(L("docker"), F.when(k % 2 == 0, L("Dockerfile")), L("pip"), F.when(k % 5 != 0, L("requirements.txt"))), lambda _, v: v.isNotNull())
    rows = table(spark, sf, "supplier").select(
        F.concat(L("study"), s(k)).alias("study_id"), F.when(k % 7 == 0, L("error")).otherwise("ok").alias("status"), F.when(k % 4 != 0, F.struct(kinds.alias("by_type"), (k % 9).cast("int").alias("n_found"))).alias("artifacts"),
        F.struct(F.when(k % 3 == 0, L("MIT")).alias("software_license"), F.md5("s_name").alias("commit_hash")).alias("repo_meta"), F.struct((k % 100).cast("int").alias("triples")).alias("lift"), F.struct(F.when(k % 2 == 1, L("3.9")).alias("declared")).alias("python"), build.alias("build"),
    )
    rows.write.json(path)
    return records.flatten_results(spark.read.schema(records.RESULT).json(path))


def flat_results(spark, sf):
    return _results(spark, sf).select("study_id", "status", "n_found", "has_docker", "has_pip", "has_licence", "has_commit", "triples", "python_declared", "attempted", "resolved", "built", "stage_failed")


def predictor_features(spark, sf):
    return records.predictors(_results(spark, sf)).select("study_id", "has_docker", "has_pip", "has_licence", "has_commit", "resolved", "built", "declares_python", F.round("log_triples", 6).alias("log_triples"))


def stored_index(spark, sf):
    """Chunks with embeddings written as an index, read again and searched."""
    path = place(spark, "index")
    records.write_index(table(spark, sf, "embeddings").select("vec_id", L(0).alias("pos"), L("chunk").alias("chunk"), "embedding"), path)
    index = records.read_index(spark, path)
    return extraction.top_k(index, index.filter("vec_id % 50 = 0"), "vec_id", "embedding", 3).select("query", "vec_id", C("place").cast("long").alias("place"))


def checksums(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", L("")), 256).alias("sha256"))


# --- operators of the second round ------------------------------------------------------------------


def conda_file_dependencies(spark, sf):
    """Parts as environment files: conda entries, and pip entries nested in them."""
    k = C("p_partkey")
    text = F.concat(
        L("# made\nname: '"), C("p_type"), L("'\nchannels:\n  - defaults  # first\n  - conda-forge\ndependencies:\n  - python=3."), s(k % 12), L("\n  - \"numpy>=1."), s(C("p_size")), L("\"\n"), F.when(k % 3 == 0, L("  - pip\n  - pip:\n    - Torch[cuda]==2.1.0\n    - git+https://x.org/a/Tool.git@main\n    - requests\n")).otherwise(L("")),
        F.when(k % 2 == 0, L("  - scipy\n")).otherwise(L("")), L("prefix: /opt/x\n"),
    )
    out = parsing.conda_dependencies(table(spark, sf, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")
    return out.select("p_partkey", "kind", C("pos").cast("long").alias("pos"), "name", "version")


def dockerfile_variables(spark, sf):
    k = C("s_suppkey")
    text = F.concat(L("FROM org/image:1-cuda12."), s(k % 4), L("\nARG TORCH_VERSION=2."), s(k % 3), L("\nARG EMPTY\nENV A=1 B=\"x\" \nENV LANG C.UTF-8\nLABEL maintainer=\"Jo Doe\" v='"), s(k), L("'\n"), F.when(k % 3 == 0, F.concat(L("env A=2 CUDA_VER=11."), s(k % 9), L("\n"))).otherwise(L("")), F.when(k % 5 == 0, L("ARG PYTHON_VERSION=3.9\n")).otherwise(L("")))
    v = table(spark, sf, "supplier").select("s_suppkey", parsing.dockerfile_variables(text).alias("v"), parsing.dockerfile(text)["image"].alias("image"))
    out = v.withColumn("x", parsing.dockerfile_versions(C("v"), C("image")))
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], L("="), e["value"])), ";")
    return out.select("s_suppkey", flat("v.env").alias("env"), flat("v.args").alias("args"), flat("v.labels").alias("labels"), "x.cuda", "x.python", "x.torch")


def _recipes(spark, sf, side):
    k = C("p_partkey")
    name = F.split_part("p_name", L(" "), L(1)) if side else C("p_name")
    return table(spark, sf, "part").filter(L(side == 0) | (k % 4 != 0)).select(
        s(k).alias("study"), F.when(L(side == 0) | (k % 3 != 0), F.concat(L("python main.py --data "), name)).alias("run_command"), F.array(F.struct(name.alias("name"), L("wget").alias("download"))).alias("requires_dataset"),
        F.when(L(side == 0) | (k % 5 != 0), F.array(F.struct(L("accuracy").alias("metric"), L("d").alias("dataset")))).alias("produces_metric"), F.when(k % 2 == 0, L("MAIN.py")).otherwise("run.py").alias("entry_point"),
    )


def recipe_metrics(spark, sf):
    return evaluation.recipe_scores(_recipes(spark, sf, 0), _recipes(spark, sf, 1), "study")


def recipe_averages(spark, sf):
    return evaluation.recipe_averages(recipe_metrics(spark, sf))


def _candidates(spark, sf):
    k = C("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.when(k % 5 != 0, F.concat(L("https://github.com/o/r"), s(k))).otherwise("https://x.org/r").alias("repo"), F.when(k % 3 == 0, F.lpad(s(k % 30), 2, "0")).when(k % 3 == 1, L("abc")).alias("arxiv"), (k % 11 == 0).alias("archived"), F.when(k % 4 == 0, L("C++")).when(k % 4 == 1, L("Python")).alias("language"), (k % 7).cast("int").alias("points"))


def candidate_reasons(spark, sf):
    return corpus.reasons(_candidates(spark, sf), corpus.candidate_rules(C("repo"), C("arxiv"), C("archived"), C("language"), C("points")))


def candidate_target(spark, sf):
    rules = corpus.candidate_rules(C("repo"), C("arxiv"), C("archived"), C("language"), C("points"))
    return corpus.first_passing(_candidates(spark, sf), rules, 40, corpus.seeded_order(C("c_custkey")), C("c_custkey")).select("c_custkey")


def repository_reasons(spark, sf):
    k = C("s_suppkey")
    files = F.create_map(L("Dockerfile"), k % 3 == 0, L("environment.yml"), k % 5 == 0, L("setup.py"), L(True))
    rows = table(spark, sf, "supplier").select("s_suppkey", F.when(k % 7 != 0, C("s_name")).alias("repo"), files.alias("env_files"), (k % 2 == 0).alias("pdf"))
    return corpus.reasons(rows, corpus.repository_rules(C("repo"), C("env_files"), C("pdf")))


def scored_list(spark, sf):
    """Suppliers by score, best first, with their share of the total and a short label."""
    place_of = F.row_number().over(W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    slug = F.when(C("s_suppkey") % 3 == 0, L("Org/Qwen2-7B")).when(C("s_suppkey") % 3 == 1, L("mixtral-8x7b-mistral")).otherwise(F.concat(L("unknown-model-"), s(C("s_suppkey"))))
    return table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", place_of.cast("long").alias("place"), tx.model_label(slug).alias("label"), tx.percent(C("s_suppkey") % 8, C("s_suppkey") % 4).alias("share"))


def merge_results(spark, sf):
    """First result of each metric and split of a user."""
    e = table(spark, sf, "events")
    key = F.concat_ws("|", F.lower("event_type"), F.when(C("event_id") % 2 == 0, L("test")).when(C("event_id") % 4 == 1, L("Test")).otherwise(L("")))
    return extraction.first_wins(e, "user_id", F.lower(key), s(C("value")), "event_id")


QUERIES = {f.__name__: f for f in (
    json_documents, json_key_and_slug, folder_scan, disk_usage, text_files, json_by_key, csv_report, csv_first_fields, yaml_manifest, reports, turtle_round_trip, shape_files, flat_results, predictor_features, stored_index, checksums,
    conda_file_dependencies, dockerfile_variables, recipe_metrics, recipe_averages, candidate_reasons, candidate_target, repository_reasons, scored_list, merge_results,
)}

_CANDIDATES = """c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'host' WHEN c_custkey % 3 = 0 AND NOT c_custkey % 30 BETWEEN 19 AND 25 THEN 'year' WHEN c_custkey % 11 = 0 THEN 'archived' WHEN c_custkey % 4 = 0 THEN 'language' WHEN c_custkey % 7 < 3 THEN 'score' ELSE 'kept' END AS reason FROM customer)"""
_RECIPES = """r AS (SELECT p_partkey, p_partkey % 3 <> 0 AS said, p_name AS a, split_part(p_name, ' ', 1) AS b, p_partkey % 5 <> 0 AS measured, p_partkey % 2 = 0 AS main FROM part WHERE p_partkey % 4 <> 0),
w AS (SELECT *, list_distinct(regexp_extract_all(lower('python main.py --data ' || a), '[a-z0-9_./-]+')) AS ga, CASE WHEN said THEN list_distinct(regexp_extract_all(lower('python main.py --data ' || b), '[a-z0-9_./-]+')) ELSE [] END AS pa FROM r),
m AS (SELECT p_partkey::VARCHAR AS study, said AS has_command, said AND main AS entry_point_hit, round(len(list_intersect(ga, pa))::DOUBLE / (len(ga) + len(pa) - len(list_intersect(ga, pa))), 3) AS command_jaccard, 1.0::DOUBLE AS dataset_f1, CASE WHEN measured THEN 1.0 ELSE 0.0 END::DOUBLE AS metric_f1 FROM w)"""

ORACLES = {
    "json_documents": "SELECT printf('study%03d', n_nationkey) AS study_id, n_name AS status, n_regionkey + 0.5::DOUBLE AS duration_s FROM nation WHERE n_nationkey % 10 <> 3",
    "json_key_and_slug": "SELECT printf('study%03d', n_nationkey) AS study, CASE WHEN n_nationkey % 2 = 1 THEN 'model-' || n_regionkey END AS slug, n_name AS status FROM nation WHERE n_nationkey % 10 <> 3",
    "folder_scan": "SELECT repeat('d/', n_nationkey % 4) || n_nationkey || '.txt' AS rel_path, n_nationkey % 4 AS depth, len(n_name) + 1 AS length FROM nation",
    "disk_usage": "SELECT count(*) AS n_files, sum(3 * len(r_name) + 1)::BIGINT AS bytes FROM region",
    "text_files": "SELECT n_nationkey || '.md' AS file_name, substr(n_name || chr(10) || 'second line' || chr(10), 1, 12) AS text FROM nation",
    "json_by_key": "SELECT c_mktsegment, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1",
    "csv_report": """SELECT r_regionkey, r_name || ', "x"' AS title, 'a; ' || r_name AS tags FROM region""",
    "csv_first_fields": """SELECT r_regionkey::VARCHAR AS key, r_name || ', "x"' AS title FROM region""",
    "yaml_manifest": "SELECT n_name AS study, n_regionkey AS claims FROM nation WHERE n_nationkey % 3 <> 0",
    "reports": r"""WITH r AS (SELECT max(len(r_name)) AS w FROM region), k AS (SELECT r_regionkey, r_name FROM region WHERE r_name LIKE '%AFRICA%')
      SELECT '| ' || r_regionkey || ' | ' || r_name || '_&\|x |' AS line FROM k UNION ALL SELECT rpad(r_regionkey::VARCHAR, 11, ' ') || '  ' || r_name || '_&|x' FROM k UNION ALL SELECT r_regionkey || ' & ' || r_name || '\_\&|x \\' FROM k""",
    "turtle_round_trip": "WITH " + QUADS + " SELECT * FROM quads",
    "shape_files": "SELECT * FROM (VALUES " + ", ".join("({})".format(", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in row)) for row in shapes.CONSTRAINTS) + ") t(shape, target, path, severity, min_count, datatype, class, not_value)",
    "flat_results": """SELECT 'study' || k AS study_id, CASE WHEN k % 7 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN k % 4 <> 0 THEN k % 9 ELSE 0 END AS n_found, k % 4 <> 0 AND k % 2 = 0 AS has_docker, k % 4 <> 0 AND k % 5 <> 0 AS has_pip, k % 3 = 0 AS has_licence, true AS has_commit, k % 100 AS triples,
      CASE WHEN k % 2 = 1 THEN '3.9' END AS python_declared, k % 3 <> 0 AS attempted, CASE WHEN k % 3 = 1 THEN k % 2 = 0 END AS resolved, CASE WHEN k % 6 = 1 THEN true END AS built, CASE WHEN k % 3 = 2 THEN 'resolve' END AS stage_failed FROM (SELECT s_suppkey AS k FROM supplier) t""",
    "predictor_features": """SELECT 'study' || k AS study_id, (k % 4 <> 0 AND k % 2 = 0)::INT AS has_docker, (k % 4 <> 0 AND k % 5 <> 0)::INT AS has_pip, (k % 3 = 0)::INT AS has_licence, 1 AS has_commit, CASE WHEN k % 3 = 1 THEN (k % 2 = 0)::INT END AS resolved, CASE WHEN k % 6 = 1 THEN 1 END AS built, (k % 2 = 1)::INT AS declares_python,
      round(ln(1 + k % 100), 6) AS log_triples FROM (SELECT s_suppkey AS k FROM supplier) t""",
    "stored_index": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS x FROM embeddings), u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM e),
      s AS (SELECT q.vec_id AS query, v.vec_id, round(list_dot_product(q.x, v.x) / (q.n * v.n), 6) AS score FROM u v CROSS JOIN u q WHERE q.vec_id % 50 = 0)
      SELECT query, vec_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM s) t WHERE place <= 3""",
    "checksums": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "conda_file_dependencies": """WITH p AS (SELECT p_partkey AS k, p_size FROM part)
      SELECT k AS p_partkey, 'conda' AS kind, 0::BIGINT AS pos, 'python' AS name, '3.' || (k % 12) AS version FROM p UNION ALL SELECT k, 'conda', 1, 'numpy', '1.' || p_size FROM p
      UNION ALL SELECT k, 'conda', 2, 'pip', 'unspecified' FROM p WHERE k % 3 = 0 UNION ALL SELECT k, 'conda', CASE WHEN k % 3 = 0 THEN 3 ELSE 2 END, 'scipy', 'unspecified' FROM p WHERE k % 2 = 0
      UNION ALL SELECT k, 'pip', unnest([0, 1, 2]), unnest(['torch', 'tool', 'requests']), unnest(['2.1.0', 'unspecified', 'unspecified']) FROM p WHERE k % 3 = 0""",
    "dockerfile_variables": """SELECT k AS s_suppkey, CASE WHEN k % 3 = 0 THEN 'A=2;B=x;CUDA_VER=11.' || (k % 9) || ';LANG=C.UTF-8' ELSE 'A=1;B=x;LANG=C.UTF-8' END AS env, 'EMPTY=' || CASE WHEN k % 5 = 0 THEN ';PYTHON_VERSION=3.9' ELSE '' END || ';TORCH_VERSION=2.' || (k % 3) AS args,
      'maintainer=Jo Doe;v=' || k AS labels, CASE WHEN k % 3 = 0 THEN '11.' || (k % 9) ELSE '12.' || (k % 4) END AS cuda, CASE WHEN k % 5 = 0 THEN '3.9' END AS python, '2.' || (k % 3) AS torch FROM (SELECT s_suppkey AS k FROM supplier) t""",
    "recipe_metrics": f"WITH {_RECIPES} SELECT * FROM m",
    "recipe_averages": f"WITH {_RECIPES} SELECT count(*) AS n_studies, round(avg(has_command::INT), 3) AS has_command, round(avg(entry_point_hit::INT), 3) AS entry_point_hit, round(avg(command_jaccard), 3) AS command_jaccard, round(avg(dataset_f1), 3) AS dataset_f1, round(avg(metric_f1), 3) AS metric_f1 FROM m",
    "candidate_reasons": f"WITH {_CANDIDATES} SELECT reason, count(*) AS n FROM c GROUP BY 1",
    "candidate_target": f"WITH {_CANDIDATES} SELECT c_custkey FROM c WHERE reason = 'kept' ORDER BY md5(c_custkey || '|42'), c_custkey LIMIT 40",
    "repository_reasons": "SELECT CASE WHEN k % 7 = 0 THEN 'missing_repo' WHEN k % 3 <> 0 AND k % 5 <> 0 THEN 'missing_env' WHEN k % 2 <> 0 THEN 'missing_pdf' ELSE 'kept' END AS reason, count(*) AS n FROM (SELECT s_suppkey AS k FROM supplier) t GROUP BY 1",
    "scored_list": """SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place, CASE s_suppkey % 3 WHEN 0 THEN 'qwen' WHEN 1 THEN 'mistral' ELSE 'unknown-mode' END AS label,
      CASE WHEN s_suppkey % 4 = 0 THEN '—' ELSE printf('%.1f', 100.0 * (s_suppkey % 8) / (s_suppkey % 4)) || '%' END AS share FROM supplier""",
    "merge_results": "SELECT user_id, lower(event_type) || '|' || CASE WHEN event_id % 4 <> 3 THEN 'test' ELSE '' END AS key, arg_min(value, event_id)::VARCHAR AS value FROM events GROUP BY 1, 2",
}
