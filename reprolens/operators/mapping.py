"""Records to quads: parsed configuration, management plans, registry entries, extractions, recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprolens.functions.text import clean
from reprolens.operators.graph import merge, mint, to_quads

# Registry licence ids with their SPDX forms; others stay as they are.
SPDX = {
    "cc-by-4.0": "CC-BY-4.0", "cc-by-sa-4.0": "CC-BY-SA-4.0", "cc-zero": "CC0-1.0", "cc0-1.0": "CC0-1.0", "mit": "MIT", "apache-2.0": "Apache-2.0", "bsd-3-clause": "BSD-3-Clause",
    "gpl-3.0": "GPL-3.0", "gpl-3.0-only": "GPL-3.0-only", "gpl-3.0-or-later": "GPL-3.0-or-later",
}
PUBLICATION = r"(?i)supplementto|documents|ispartof|publication"
C = F.col


def graph_of(study: Column) -> Column:
    return F.concat(F.lit("study/"), study)


def spdx(licence: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SPDX.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(licence))), licence)


def access_level(right: Column) -> Column:
    low = F.lower(right)
    return F.when(low.contains("open") | low.contains("public"), "open").otherwise(low)


def record_id(doi: Column) -> Column:
    """The number at the end of a registry DOI, or the trimmed text itself."""
    return F.coalesce(F.nullif(F.regexp_extract(doi, r"zenodo\.([0-9]+)", 1), F.lit("")), F.trim(doi))


def dependencies(rows: DataFrame) -> DataFrame:
    """(study, name, version, kind) of parsed dependencies: one node each, linked from the study's software."""
    g, app = graph_of(C("study")), F.concat(F.lit("software/"), C("study"))
    node = mint("dep", C("study"), C("name"), C("kind"))
    version = F.coalesce(clean(C("version")), F.lit("unspecified"))
    nodes = to_quads(rows, g, node, "SoftwareDependency", {"dependencyName": C("name"), "dependencyVersion": version, "dependencyType": C("kind")})
    return merge(nodes, to_quads(rows, g, app, "SoftwareApplication", links={"softwareDependency": node}), to_quads(rows, g, F.concat(F.lit("activity/"), C("study")), "ResearchActivity", links={"usedSoftware": app}))


def environment(rows: DataFrame) -> DataFrame:
    """(study, image, digest, cuda, os, gpu) of a container: an environment with its specification."""
    g, env, spec = graph_of(C("study")), F.concat(F.lit("env/"), C("study")), F.concat(F.lit("envspec/"), C("study"))
    return merge(
        to_quads(rows, g, env, "ComputingEnvironment", {"cudaVersion": C("cuda"), "osVersion": C("os"), "gpuModel": C("gpu")}, {"hasEnvironmentSpec": spec}),
        to_quads(rows, g, spec, "EnvironmentSpec", {"specType": F.lit("docker"), "imageDigest": C("digest"), "specUri": C("image")}),
        to_quads(rows, g, F.concat(F.lit("activity/"), C("study")), "ResearchActivity", links={"executedIn": env}),
    )


def registry(rows: DataFrame) -> DataFrame:
    """(study, doi, title, licence, access_right, landing, formats, relations[{relation, identifier}]) of a repository entry."""
    g, node, activity = graph_of(C("study")), F.concat(F.lit("dataset/"), record_id(C("doi"))), F.concat(F.lit("activity/"), C("study"))
    formats = F.slice(F.array_sort(F.array_distinct(F.coalesce("formats", F.array().cast("array<string>")))), 1, 4)
    formats = F.when(F.size(formats) == 0, F.array(F.lit("datacite"))).otherwise(formats)
    base = to_quads(rows, g, node, "Dataset", {"identifier": F.concat(F.lit("https://doi.org/"), C("doi")), "rdfs:label": C("title"), "dataLicense": spdx(C("licence")), "accessLevel": access_level(C("access_right")), "datasetLandingPage": C("landing")})
    shapes = to_quads(rows.withColumn("format", F.explode(formats)), g, node, None, {"dataFormat": C("format")})
    related = rows.withColumn("r", F.explode("relations"))
    publication = C("r.relation").rlike(PUBLICATION)
    links = to_quads(related, g, activity, None, links={"generatesPublication": F.when(publication, C("r.identifier")), "citesDataset": F.when(~publication, C("r.identifier"))})
    return merge(base, shapes, links, to_quads(rows, g, activity, "ResearchActivity", links={"generatesDataset": node}))


def management_plan(rows: DataFrame) -> DataFrame:
    """(study, plan) with a maDMP document as JSON: project, datasets with their first distribution and licence, contributors."""
    schema = "project array<struct<title:string,funding:array<struct<name:string>>>>, dataset array<struct<title:string,dataset_id:struct<identifier:string>,distribution:array<struct<access_url:string,data_access:string,license:array<struct<license_ref:string>>>>>>, contributor array<struct<name:string,role:array<string>>>"
    p = rows.select("study", F.from_json("plan", schema).alias("p"))
    g, activity = graph_of(C("study")), F.concat(F.lit("activity/"), C("study"))
    project = F.get("p.project", F.lit(0))
    head = to_quads(p, g, activity, "ResearchActivity", {"rdfs:label": F.coalesce(project["title"], F.lit("untitled")), "funding": F.get(project["funding"], F.lit(0))["name"]})
    d = p.withColumn("d", F.explode("p.dataset")).withColumn("first", F.get("d.distribution", F.lit(0)))
    node = mint("dataset", C("study"), F.coalesce("d.dataset_id.identifier", "d.title"))
    data = to_quads(d, g, node, "Dataset", {"identifier": C("d.dataset_id.identifier"), "rdfs:label": C("d.title"), "dataLicense": F.get("first.license", F.lit(0))["license_ref"], "accessLevel": access_level(C("first.data_access")), "datasetLandingPage": C("first.access_url")})
    people = p.withColumn("c", F.explode("p.contributor"))
    person = mint("person", C("study"), C("c.name"))
    return merge(head, data, to_quads(d, g, activity, None, links={"generatesDataset": node}), to_quads(people, g, person, "Person", {"name": C("c.name"), "role": F.array_join("c.role", ", ")}))


def extraction(rows: DataFrame) -> DataFrame:
    """Extraction records (EXTRACTION schema) to quads of the study's graph; entries without a name give none."""
    r = rows.select(C("study_id").alias("study"), C("metadata").alias("m"))
    g, activity = graph_of(C("study")), F.concat(F.lit("activity/"), C("study"))

    def items(field: str) -> DataFrame:
        return r.select("study", F.explode(f"m.{field}").alias("x"))

    def part(field: str, prefix: str, kind: str, link: str, keys: list[Column], literals: dict[str, Column], test: Column) -> DataFrame:
        rows_ = items(field).filter(test)
        node = mint(prefix, C("study"), *[F.coalesce(k, F.lit("")) for k in keys])
        return merge(to_quads(rows_, g, node, kind, literals), to_quads(rows_, g, activity, None, links={link: node}))

    x = lambda name: clean(C(f"x.{name}"))
    named = x("name").isNotNull()
    seeds = r.select("study", F.explode("m.random_seeds").alias("x")).withColumn("v", C("x").cast("string"))
    seed = mint("seed", C("study"), C("v"))
    deps = items("dependencies").filter(named).select("study", x("name").alias("name"), x("version").alias("version"), F.lit("extracted").alias("kind"))
    env = F.concat(F.lit("env/"), C("study"))
    gpu, cuda = clean(C("m.hardware.gpu_model")), clean(C("m.hardware.cuda_version"))
    machine = r.filter(gpu.isNotNull() | cuda.isNotNull())
    return merge(
        to_quads(r, g, activity, "DataAnalysisActivity"),
        dependencies(deps),
        to_quads(seeds, g, seed, "RandomSeed", {"parameterName": F.lit("random_seed"), "parameterValue": C("v"), "parameterDataType": F.lit("xsd:integer")}),
        to_quads(seeds, g, activity, None, links={"hasParameter": seed}),
        part("hyperparameters", "param", "Parameter", "hasParameter", [C("x.name"), C("x.value")], {"parameterName": x("name"), "parameterValue": x("value"), "parameterDataType": F.lit("xsd:string")}, named),
        part("methods", "method", "Method", "usedMethod", [C("x.name")], {"title": x("name"), "description": x("description")}, named),
        part("datasets", "dataset", "Dataset", "usedDataset", [C("x.name"), C("x.version")], {"title": x("name"), "version": x("version")}, named),
        part("evaluation_results", "result", "EvaluationResult", "generatesResult", [C("x.metric"), C("x.value"), C("x.split")], {"metricName": x("metric"), "metricValue": x("value"), "splitLabel": x("split")}, x("metric").isNotNull()),
        to_quads(machine, g, env, "ComputingEnvironment", {"gpuModel": gpu, "cudaVersion": cuda}),
        to_quads(machine, g, activity, None, links={"executedIn": env}),
    )


def recipe(rows: DataFrame) -> DataFrame:
    """Execution recipes (RECIPE schema) to quads."""
    g, node, activity = graph_of(C("study_id")), F.concat(F.lit("recipe/"), C("study_id")), F.concat(F.lit("activity/"), C("study_id"))
    one = to_quads(rows, g, node, "ExecutionRecipe", {"runCommand": clean(C("run_command")), "entryPoint": clean(C("entry_point")), "requiresCheckpoint": clean(C("requires_checkpoint")), "recipeConfidence": C("confidence")})
    many = [to_quads(rows.withColumn("x", F.explode(field)), g, node, None, {p: value}) for field, p, value in (("setup_steps", "setupStep", C("x")), ("requires_dataset", "requiresDataset", C("x.name")), ("produces_metric", "producesMetric", C("x.metric")))]
    return merge(one, *many, to_quads(rows, g, activity, None, links={"hasExecutionRecipe": node}))
