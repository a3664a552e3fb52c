"""Shape validation: a table of property constraints against quads, one typed row for each failure."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprolens.sources import turtle

SCHEMA = "shape string, target string, path string, severity string, min_count int, datatype string, class string, not_value string"
V, W, TEXT = "Violation", "Warning", "xsd:string"
#: The property constraints (shape, target class, path, severity, least count, datatype, class of the value, forbidden value).
CONSTRAINTS = (
    ("FindableActivityShape", "ResearchActivity", "identifier", V, 1, None, None, None),
    ("FindableActivityShape", "ResearchActivity", "rdfs:label", V, 1, None, None, None),
    ("AccessibleDatasetShape", "Dataset", "dataLicense", V, 1, None, None, None),
    ("AccessibleDatasetShape", "Dataset", "accessLevel", W, 1, None, None, None),
    ("AccessibleDatasetShape", "Dataset", "datasetLandingPage", W, 1, None, None, None),
    ("ActivityGeneratesDatasetShape", "ResearchActivity", "generatesDataset", W, 1, None, None, None),
    ("InteroperableActivityShape", "ResearchActivity", "usedMethod", W, 1, None, None, None),
    ("MethodWorkflowShape", "Method", "workflowLanguage", W, 1, None, None, None),
    ("ReusableSoftwareShape", "SoftwareApplication", "softwareLicense", V, 1, None, None, None),
    ("ReusableSoftwareShape", "SoftwareApplication", "commitHash", W, 1, None, None, None),
    ("ActivityUsesSoftwareShape", "ResearchActivity", "usedSoftware", W, 1, None, None, None),
    ("MethodologicalActivityShape", "ResearchActivity", "usedMethod", W, 1, None, None, None),
    ("MethodologicalActivityShape", "ResearchActivity", "hasParameter", W, 1, None, None, None),
    ("EvaluationResultShape", "EvaluationResult", "metricName", W, 1, None, None, None),
    ("EvaluationResultShape", "EvaluationResult", "metricValue", W, 1, None, None, None),
    ("ProvenanceActivityShape", "ResearchActivity", "generatesDataset", W, 1, None, None, None),
    ("EnvironmentSpecShape", "EnvironmentSpec", "imageDigest", V, 1, TEXT, None, None),
    ("EnvironmentSpecShape", "EnvironmentSpec", "specType", W, 1, TEXT, None, None),
    ("EnvironmentSpecShape", "EnvironmentSpec", "specUri", W, 1, TEXT, None, None),
    ("ComputingEnvironmentShape", "ComputingEnvironment", "cudaVersion", W, 1, TEXT, None, None),
    ("ComputingEnvironmentShape", "ComputingEnvironment", "osVersion", W, 1, TEXT, None, None),
    ("ResearchActivityEnvShape", "ResearchActivity", "executedIn", V, 1, None, "ComputingEnvironment", None),
    ("SoftwareDependencyShape", "SoftwareDependency", "dependencyName", V, 1, TEXT, None, None),
    ("SoftwareDependencyShape", "SoftwareDependency", "dependencyVersion", V, 1, TEXT, None, None),
    ("SoftwareDependencyShape", "SoftwareDependency", "dependencyType", W, 1, TEXT, None, None),
    ("SoftwareDependencyVersionShape", "SoftwareDependency", "dependencyVersion", W, 0, None, None, "unspecified"),
    ("SoftwareApplicationShape", "SoftwareApplication", "softwareDependency", V, 1, None, "SoftwareDependency", None),
    ("RandomSeedShape", "RandomSeed", "parameterName", V, 1, TEXT, None, None),
    ("RandomSeedShape", "RandomSeed", "parameterValue", V, 1, TEXT, None, None),
    ("RandomSeedShape", "RandomSeed", "parameterDataType", W, 1, TEXT, None, None),
    ("DataAnalysisActivitySeedShape", "DataAnalysisActivity", "hasParameter", W, 1, None, None, None),
    ("ParameterShape", "Parameter", "parameterName", V, 1, TEXT, None, None),
    ("ParameterShape", "Parameter", "parameterValue", V, 1, TEXT, None, None),
)


def constraints(spark: SparkSession, rows: tuple = CONSTRAINTS) -> DataFrame:
    return spark.createDataFrame(list(rows), SCHEMA)


def from_turtle(spark: SparkSession, pattern: str) -> DataFrame:
    """The constraint table (SCHEMA) of all shape files that match: their triples are merged, then read."""
    texts = [r.value for r in spark.read.text(pattern, wholetext=True).select("value").collect()]  # a few small files
    triples = [t for i, text in enumerate(texts) for t in turtle.triples(text, f"f{i}-")]
    by: dict[str, dict[str, list[str]]] = {}
    for s, p, o, _, _ in triples:
        by.setdefault(s, {}).setdefault(p, []).append(o)
    one = lambda node, p: (node.get(p) or [None])[0]
    rows = []
    for shape, node in by.items():
        for target in node.get("sh:targetClass", []):
            for prop in (by.get(x, {}) for x in node.get("sh:property", [])):
                forbidden = one(by.get(one(prop, "sh:not"), {}), "sh:hasValue")
                severity = (one(prop, "sh:severity") or "sh:Violation").rpartition(":")[2]
                least = int(one(prop, "sh:minCount") or 0)
                rows.append((bare(shape), bare(target), bare(one(prop, "sh:path")), severity, least, one(prop, "sh:datatype"), bare(one(prop, "sh:class")), forbidden))
    return spark.createDataFrame(sorted(rows, key=str), SCHEMA)


def to_turtle(rows: tuple = CONSTRAINTS) -> str:
    """A shape file of the constraints."""
    out, spaces = [], {"sh": turtle.NAMESPACES["sh"], "rdfs": turtle.NAMESPACES["rdfs"], "xsd": turtle.NAMESPACES["xsd"], "rdip": "https://w3id.org/rdip/"}
    own = lambda n: n if ":" in n else f"rdip:{n}"
    for shape, group in itertools.groupby(rows, key=lambda r: r[0]):
        parts = []
        for _, target, path, severity, least, datatype, kind, forbidden in group:
            facts = [f"sh:path {own(path)}", f"sh:severity sh:{severity}"] + [f"sh:minCount {least}"] * bool(least)
            facts += [f"sh:datatype {datatype}"] * bool(datatype) + ([f"sh:class {own(kind)}"] if kind else [])
            facts += [f'sh:not [ sh:hasValue "{forbidden}" ]'] * bool(forbidden)
            parts.append("sh:property [ " + " ; ".join(facts) + " ]")
        out.append(f"rdip:{shape} a sh:NodeShape ;\n    sh:targetClass rdip:{target} ;\n    " + " ;\n    ".join(parts) + " .")
    return "\n".join([*(f"@prefix {p}: <{s}> ." for p, s in spaces.items()), "", *out]) + "\n"


def bare(name: str | None, own: str = "rdip:") -> str | None:
    """Names of the own vocabulary go without their prefix, as everywhere here."""
    return name.removeprefix(own) if name else None


def validate(quads: DataFrame, rules: DataFrame) -> DataFrame:
    """graph, focus, shape, path, severity, problem: a row for each failing focus node and constraint.

    Problems: min_count, datatype (a value is no literal of that type), class (a value has no such type), not_value.
    """
    types = quads.filter(F.col("p") == "rdf:type").select("graph", F.col("s").alias("focus"), F.col("o").alias("target"))
    checks = types.join(F.broadcast(rules), "target")  # the constraint table has a fixed size
    values = quads.select("graph", F.col("s").alias("focus"), F.col("p").alias("path"), "o", "o_kind", "o_type")
    value_types = quads.filter(F.col("p") == "rdf:type").select("graph", F.col("s").alias("o"), F.col("o").alias("value_type"))
    of_class = value_types.groupBy("graph", "o").agg(F.collect_set("value_type").alias("value_types"))
    found = checks.join(values, ["graph", "focus", "path"], "left").join(of_class, ["graph", "o"], "left")
    has = F.col("o").isNotNull()
    tally = found.groupBy("graph", "focus", "shape", "target", "path", "severity", "min_count", "datatype", "class", "not_value").agg(
        F.count("o").alias("n"),
        F.coalesce(F.bool_or(has & F.col("datatype").isNotNull() & ~((F.col("o_kind") == "literal") & F.coalesce(F.col("o_type") == F.col("datatype"), F.lit(False)))), F.lit(False)).alias("bad_type"),
        F.coalesce(F.bool_or(has & F.col("class").isNotNull() & ~F.coalesce(F.array_contains("value_types", F.col("class")), F.lit(False))), F.lit(False)).alias("bad_class"),
        F.coalesce(F.bool_or(has & (F.col("o") == F.col("not_value"))), F.lit(False)).alias("bad_value"),
    )
    problems = F.array_compact(F.array(F.when(F.col("n") < F.col("min_count"), "min_count"), F.when(F.col("bad_type"), "datatype"), F.when(F.col("bad_class"), "class"), F.when(F.col("bad_value"), "not_value")))
    return tally.select("graph", "focus", "shape", "path", "severity", F.explode(problems).alias("problem"))


def conformance(quads: DataFrame, rules: DataFrame) -> DataFrame:
    """graph, violations, warnings, conforms: warnings alone don't break conformance."""
    found = validate(quads, rules).groupBy("graph").agg(F.count_if(F.col("severity") == V).alias("violations"), F.count_if(F.col("severity") == W).alias("warnings"))
    out = quads.select("graph").distinct().join(found, "graph", "left").fillna(0, ["violations", "warnings"])
    return out.withColumn("conforms", F.col("violations") == 0)
