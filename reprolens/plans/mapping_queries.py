"""Queries that map records to quads; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reprolens.operators import graph, mapping
from reprolens.sources.tables import table

C, L = F.col, F.lit


def map_dependencies(spark, sf):
    p = table(spark, sf, "part").select(C("p_size").cast("string").alias("study"), C("p_name").alias("name"), F.when(C("p_partkey") % 7 == 0, L("n/a")).otherwise(C("p_brand")).alias("version"), L("pip").alias("kind")).groupBy("study", "name", "kind").agg(F.max("version").alias("version"))
    q = mapping.dependencies(p)
    return graph.star(q, {"dependencyName": "name", "dependencyVersion": "version"}, {"dependencyType": "kind"}, "SoftwareDependency").select("graph", "name", "version", "kind")


def map_registry(spark, sf):
    k = C("c_custkey")
    rows = table(spark, sf, "customer").select(
        k.cast("string").alias("study"), F.concat(L("10.5281/zenodo."), k.cast("string")).alias("doi"), C("c_name").alias("title"), F.when(k % 3 == 0, L("CC-BY-4.0")).when(k % 3 == 1, L("mit")).otherwise(L("other-closed")).alias("licence"),
        F.when(k % 2 == 0, L("Open Access")).otherwise(L("Restricted")).alias("access_right"), F.when(k % 5 != 0, F.concat(L("https://x.org/"), k.cast("string"))).alias("landing"), F.when(k % 4 == 0, F.array(L("csv"), L("csv"), L("txt"))).otherwise(F.array().cast("array<string>")).alias("formats"),
        F.array(F.struct(F.when(k % 2 == 0, L("isSupplementTo")).otherwise(L("references")).alias("relation"), F.concat(L("doi:"), k.cast("string")).alias("identifier"))).alias("relations"),
    )
    return mapping.registry(rows).select("graph", "s", "p", "o")


def map_recipe(spark, sf):
    k = C("s_suppkey")
    rows = table(spark, sf, "supplier").select(
        k.cast("string").alias("study_id"), F.when(k % 4 == 0, L("none")).otherwise(F.concat(L("python main.py --seed "), k.cast("string"))).alias("run_command"), F.array(L("pip install -r requirements.txt"), F.concat(L("make "), C("s_name"))).alias("setup_steps"),
        F.array(F.struct(L("data").alias("name"), L("wget").alias("download"))).alias("requires_dataset"), L(None).cast("string").alias("requires_checkpoint"), F.array(F.struct(L("accuracy").alias("metric"), L("test").alias("dataset"))).alias("produces_metric"), L("main.py").alias("entry_point"), F.when(k % 2 == 0, "high").otherwise("low").alias("confidence"),
    )
    return mapping.recipe(rows).select("graph", "s", "p", "o")


def map_extraction_counts(spark, sf):
    """Users as studies: events give dependencies, seeds, methods and results."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    name = F.when(C("event_id") % 10 == 0, L("unknown")).otherwise(C("event_type"))
    m = e.groupBy("user_id").agg(
        F.collect_list(F.struct(name.alias("name"), L(None).cast("string").alias("version"))).alias("dependencies"), F.collect_set("k").alias("random_seeds"), F.collect_list(F.struct(name.alias("name"), L("x").alias("description"))).alias("methods"),
        F.collect_list(F.struct(name.alias("metric"), C("value").cast("string").alias("value"), L(None).cast("string").alias("split"))).alias("evaluation_results"), F.collect_list(F.struct(name.alias("name"), L("1").alias("value"))).alias("hyperparameters"), F.collect_list(F.struct(L("null").alias("name"), L("1").alias("version"))).alias("datasets"),
        F.struct(F.max(F.when(C("event_type") == "error", L("A100"))).alias("gpu_model"), L("n/a").alias("cuda_version"), L(None).cast("string").alias("cpu_info")).alias("hardware"),
    )
    rows = m.select(C("user_id").cast("string").alias("study_id"), F.struct("dependencies", "random_seeds", "hardware", "hyperparameters", "datasets", "methods", "evaluation_results").alias("metadata"))
    return graph.type_counts(mapping.extraction(rows))


def management_plan_fields(spark, sf):
    k = C("s_suppkey")
    plan = F.to_json(F.struct(F.array(F.struct(C("s_name").alias("title"), F.when(k % 2 == 0, F.array(F.struct(L("fund").alias("name")))).alias("funding"))).alias("project"), F.array(F.struct(F.concat(L("d"), k.cast("string")).alias("title"), F.array(F.struct(L("http://a.b/c").alias("access_url"), L("open").alias("data_access"), F.array(F.struct(L("MIT").alias("license_ref"))).alias("license"))).alias("distribution"))).alias("dataset"), F.array(F.struct(L("Ann").alias("name"), F.array(L("PI"), L("author")).alias("role"))).alias("contributor")))
    q = mapping.management_plan(table(spark, sf, "supplier").select(k.cast("string").alias("study"), plan.alias("plan")))
    return q.groupBy("graph", "p").agg(F.count("*").alias("n"), F.min(F.when(C("o_kind") == "literal", C("o"))).alias("value"))


QUERIES = {f.__name__: f for f in (map_dependencies, map_registry, map_recipe, map_extraction_counts, management_plan_fields)}
_E = "e AS (SELECT user_id, (props->>'$.k')::INT AS k, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS name, event_type, value FROM events)"
ORACLES = {
    "map_dependencies": "SELECT 'study/' || p_size AS graph, p_name AS name, CASE WHEN max(CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE p_brand END) = 'n/a' THEN 'unspecified' ELSE max(CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE p_brand END) END AS version, 'pip' AS kind FROM part GROUP BY p_size, p_name",
    "map_registry": """WITH t AS (SELECT c_custkey AS k, c_name FROM customer), q AS (
      SELECT 'study/' || k AS graph, 'dataset/' || k AS s, unnest(['rdf:type', 'identifier', 'rdfs:label', 'dataLicense', 'accessLevel', 'datasetLandingPage', 'dataFormat']) AS p,
        unnest(['Dataset', 'https://doi.org/10.5281/zenodo.' || k, c_name, CASE k % 3 WHEN 0 THEN 'CC-BY-4.0' WHEN 1 THEN 'MIT' ELSE 'other-closed' END, CASE WHEN k % 2 = 0 THEN 'open' ELSE 'restricted' END, CASE WHEN k % 5 <> 0 THEN 'https://x.org/' || k END, CASE WHEN k % 4 = 0 THEN 'csv' ELSE 'datacite' END]) AS o FROM t
      UNION ALL SELECT 'study/' || k, 'dataset/' || k, 'dataFormat', 'txt' FROM t WHERE k % 4 = 0
      UNION ALL SELECT 'study/' || k, 'activity/' || k, unnest(['rdf:type', 'generatesDataset', CASE WHEN k % 2 = 0 THEN 'generatesPublication' ELSE 'citesDataset' END]), unnest(['ResearchActivity', 'dataset/' || k, 'doi:' || k]) FROM t) SELECT * FROM q WHERE o IS NOT NULL""",
    "map_recipe": """WITH t AS (SELECT s_suppkey AS k, s_name FROM supplier), q AS (
      SELECT 'study/' || k AS graph, 'recipe/' || k AS s, unnest(['rdf:type', 'runCommand', 'entryPoint', 'recipeConfidence', 'setupStep', 'setupStep', 'requiresDataset', 'producesMetric']) AS p,
        unnest(['ExecutionRecipe', CASE WHEN k % 4 <> 0 THEN 'python main.py --seed ' || k END, 'main.py', CASE WHEN k % 2 = 0 THEN 'high' ELSE 'low' END, 'pip install -r requirements.txt', 'make ' || s_name, 'data', 'accuracy']) AS o FROM t
      UNION ALL SELECT 'study/' || k, 'activity/' || k, 'hasExecutionRecipe', 'recipe/' || k FROM t) SELECT * FROM q WHERE o IS NOT NULL""",
    "map_extraction_counts": f"""WITH {_E} SELECT * FROM (
      SELECT 'DataAnalysisActivity' AS entity_type, count(DISTINCT user_id) AS n FROM e UNION ALL SELECT 'SoftwareDependency', count(DISTINCT (user_id, name)) FROM e WHERE name IS NOT NULL
      UNION ALL SELECT 'SoftwareApplication', count(DISTINCT user_id) FROM e WHERE name IS NOT NULL UNION ALL SELECT 'ResearchActivity', count(DISTINCT user_id) FROM e WHERE name IS NOT NULL
      UNION ALL SELECT 'RandomSeed', count(DISTINCT (user_id, k)) FROM e UNION ALL SELECT 'Parameter', count(DISTINCT (user_id, name)) FROM e WHERE name IS NOT NULL UNION ALL SELECT 'Method', count(DISTINCT (user_id, name)) FROM e WHERE name IS NOT NULL
      UNION ALL SELECT 'EvaluationResult', count(DISTINCT (user_id, name, value)) FROM e WHERE name IS NOT NULL UNION ALL SELECT 'ComputingEnvironment', count(DISTINCT user_id) FROM e WHERE event_type = 'error') x""",
    "management_plan_fields": """WITH t AS (SELECT s_suppkey AS k, s_name FROM supplier), q AS (
      SELECT 'study/' || k AS graph, unnest(['rdfs:label', 'rdfs:label', 'dataLicense', 'accessLevel', 'datasetLandingPage', 'generatesDataset', 'name', 'role', 'rdf:type', 'rdf:type', 'rdf:type', 'funding']) AS p,
        unnest([s_name, 'd' || k, 'MIT', 'open', 'http://a.b/c', NULL, 'Ann', 'PI, author', NULL, NULL, NULL, CASE WHEN k % 2 = 0 THEN 'fund' END]) AS v FROM t)
      SELECT graph, p, count(*) AS n, min(v) AS value FROM q WHERE p <> 'funding' OR v IS NOT NULL GROUP BY 1, 2""",
}

