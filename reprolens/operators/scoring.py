"""Graded scoring: a rubric of criteria, graded for every graph in one aggregation over its quads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprolens.operators.graph import TYPE, ask

PRIORITY = {"essential": 3, "important": 2, "useful": 1}
#: Points are counted in whole 48ths, so that sums don't depend on their order: every criterion's most is a multiple of 1/24, level 1 is half of it.
UNIT = 48
TIERS = ((85.0, "excellent"), (70.0, "good"), (50.0, "fair"), (0.0, "poor"))


def has(*predicates: str) -> Column:
    return F.col("p").isin(*predicates)


def is_a(kind: str) -> Column:
    return (F.col("p") == TYPE) & (F.col("o") == kind)


@dataclass(frozen=True)
class Criterion:
    dimension: str
    most: float  # of the dimension
    name: str
    priority: str
    present: Callable[[], Column]
    full: Callable[[], list[Column]] | None = None  # all must hold somewhere in the graph; none: present is full


def _persistent() -> Column:
    low = F.lower("o")
    return has("identifier") & (low.contains("doi.org") | low.contains("handle.net") | low.contains("zenodo") | low.contains("w3id.org") | F.col("o").contains("10."))


#: The 15 criteria.
RUBRIC = (
    Criterion("Findable", 15.0, "Persistent identifier", "essential", lambda: has("identifier"), lambda: [_persistent()]),
    Criterion("Findable", 15.0, "Descriptive metadata", "essential", lambda: has("title")),
    Criterion("Findable", 15.0, "Landing page", "essential", lambda: has("datasetLandingPage")),
    Criterion("Accessible", 15.0, "Access protocol", "essential", lambda: has("identifier") & F.col("o").startswith("http")),
    Criterion("Accessible", 15.0, "Data licence", "essential", lambda: has("dataLicense")),
    Criterion("Accessible", 15.0, "Access level", "important", lambda: has("accessLevel"), lambda: [has("accessLevel") & F.col("o").isin("open", "public", "restricted", "embargoed", "closed")]),
    Criterion("Interoperable", 20.0, "Method declared", "important", lambda: has("usedMethod")),
    Criterion("Interoperable", 20.0, "Workflow language", "important", lambda: has("workflowLanguage")),
    Criterion("Interoperable", 20.0, "Related links", "important", lambda: has("citesDataset", "derivedFrom", "generatesPublication")),
    Criterion("Reusable", 20.0, "Software licence", "essential", lambda: has("softwareLicense"), lambda: [has("softwareLicense") & ~F.col("o").isin("LicenseRef-Custom", "")]),
    Criterion("Reusable", 20.0, "Commit and versioning", "important", lambda: has("commitHash")),
    Criterion("Reusable", 20.0, "Community standard", "essential", lambda: has("dataFormat")),
)
#: The fourth dimension's shares are given, not derived from priorities.
REPRODUCIBLE = (
    (0.4, Criterion("Reproducible", 30.0, "Environment", "essential", lambda: is_a("EnvironmentSpec") | has("softwareDependency"), lambda: [has("imageDigest") & (F.col("o") != "")])),
    (0.3, Criterion("Reproducible", 30.0, "Method", "essential", lambda: is_a("RandomSeed") | has("hasParameter", "usedMethod"), lambda: [is_a("RandomSeed"), has("usedMethod")])),
    (0.3, Criterion("Reproducible", 30.0, "Provenance", "essential", lambda: is_a("EvaluationResult") | has("generatesDataset", "usedDataset"), lambda: [is_a("EvaluationResult")])),
)


def weights() -> list[tuple[Criterion, float]]:
    """Each criterion with its most points: the dimension's, shared by priority."""
    out = []
    for c in RUBRIC:
        total = sum(PRIORITY[x.priority] for x in RUBRIC if x.dimension == c.dimension)
        out.append((c, c.most * PRIORITY[c.priority] / total))
    return out + [(c, c.most * share) for share, c in REPRODUCIBLE]


def grade(quads: DataFrame) -> DataFrame:
    """graph, position, dimension, criterion, priority, level (0 absent, 1 partial, 2 full), units, max_units (48ths), points, max_points."""
    questions: dict[str, Column] = {}
    entries = []
    for i, (c, most) in enumerate(weights()):
        questions[f"p{i}"] = c.present()
        full = c.full() if c.full else []
        for k, q in enumerate(full):
            questions[f"f{i}_{k}"] = q
        level = F.when(~F.col(f"p{i}"), 0)
        for k in range(len(full)):
            level = level.when(~F.col(f"f{i}_{k}"), 1)
        level = level.otherwise(2)
        whole = round(most * UNIT)
        units = (level * (whole // 2)).cast("long")
        entries.append(F.struct(F.lit(i).alias("position"), F.lit(c.dimension).alias("dimension"), F.lit(c.name).alias("criterion"), F.lit(c.priority).alias("priority"), level.alias("level"), units.alias("units"), F.lit(whole).cast("long").alias("max_units"), (units / UNIT).alias("points"), (F.lit(whole) / UNIT).alias("max_points")))
    return ask(quads, questions).select("graph", F.inline(F.array(*entries)))


def dimensions(grades: DataFrame) -> DataFrame:
    return grades.groupBy("graph", "dimension").agg(F.bround(F.sum("units") / UNIT, 2).alias("score"), F.bround(F.sum("max_units") / UNIT, 2).alias("max_score"))


def totals(grades: DataFrame) -> DataFrame:
    raw = grades.groupBy("graph").agg(F.sum("units").alias("raw"), F.sum("max_units").alias("most"))
    tier = F.lit(TIERS[-1][1])
    for least, name in reversed(TIERS[:-1]):
        tier = F.when(F.col("raw") >= least * UNIT, name).otherwise(tier)
    return raw.select("graph", F.bround(F.col("raw") / UNIT, 2).alias("total_score"), F.bround(100 * F.col("raw") / F.col("most"), 1).alias("percent"), tier.alias("tier"))


def recommendations(grades: DataFrame) -> DataFrame:
    """What is missing, in order for each graph: by priority, then by points to win, then by place in the rubric."""
    from pyspark.sql import Window as W

    rank = F.when(F.col("priority") == "essential", 0).when(F.col("priority") == "important", 1).otherwise(2)
    open_points = F.bround((F.col("max_units") - F.col("units")) / UNIT, 2)
    out = grades.filter("level < 2").withColumn("points_available", open_points)
    place = F.row_number().over(W.partitionBy("graph").orderBy(rank, F.desc("points_available"), "position"))
    return out.select("graph", "dimension", "criterion", "priority", "level", "points_available", place.cast("long").alias("place"))
