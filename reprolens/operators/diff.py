"""Semantic diff between original and reproduction: four conflict operators over tables with a ``pair`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprolens.operators.graph import construct

UNSPECIFIED = "unspecified"
#: Environment properties with the severity of a difference.
HARDWARE = (("cuda", "HIGH"), ("gpu", "MEDIUM"), ("os", "LOW"))


def dependency_key(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit("-"), F.lit("_")))


def version_conflicts(original: DataFrame, reproduction: DataFrame) -> DataFrame:
    """(pair, name, version) on both sides: same name, both versions given, and different. An equi-join on a computed key."""
    a = original.filter(F.col("version") != UNSPECIFIED).select("pair", dependency_key(F.col("name")).alias("name"), F.col("version").alias("original_value"))
    b = reproduction.filter(F.col("version") != UNSPECIFIED).select("pair", dependency_key(F.col("name")).alias("name"), F.col("version").alias("reproduction_value"))
    return a.join(b, ["pair", "name"]).filter("original_value != reproduction_value").distinct()


def digest_conflicts(original: DataFrame, reproduction: DataFrame) -> DataFrame:
    """(pair, digest): each given original digest against all digests of the reproduction; "absent" where it has none."""
    a = original.filter((F.col("digest") != "") & (F.col("digest") != UNSPECIFIED)).select("pair", F.col("digest").alias("original_value"))
    b = reproduction.select("pair", F.col("digest").alias("reproduction_value"))
    found = a.join(b, "pair", "left").withColumn("reproduction_value", F.coalesce("reproduction_value", F.lit("absent")))
    return found.filter("original_value != reproduction_value").distinct()


def seed_conflicts(original: DataFrame, reproduction: DataFrame) -> DataFrame:
    """(pair, name, value): seeds that the reproduction lacks or gives another value."""
    a = original.select("pair", "name", F.col("value").alias("original_value"))
    b = reproduction.select("pair", "name", F.col("value").alias("reproduction_value"))
    found = a.join(b, ["pair", "name"], "left")
    return found.filter("reproduction_value is null or original_value != reproduction_value").withColumn("reproduction_value", F.coalesce("reproduction_value", F.lit("absent"))).distinct()


def hardware_conflicts(original: DataFrame, reproduction: DataFrame, properties: tuple = HARDWARE) -> DataFrame:
    """(pair, prop, value): environment properties that the reproduction lacks or has otherwise, with the property's severity."""
    spark = original.sparkSession
    known = F.broadcast(spark.createDataFrame(list(properties), "prop string, severity string"))  # a fixed, tiny table
    a = original.join(known, "prop").select("pair", "prop", "severity", F.col("value").alias("original_value"))
    b = reproduction.select("pair", "prop", F.col("value").alias("reproduction_value"))
    found = a.join(b, ["pair", "prop"], "left")
    return found.filter("reproduction_value is null or original_value != reproduction_value").withColumn("reproduction_value", F.coalesce("reproduction_value", F.lit("absent"))).distinct()


def conflict_triples(conflicts: DataFrame, kind: str, severity: str, *keys: str) -> DataFrame:
    """A node with six triples for each conflict row; its name hashes the pair and the keys."""
    node = F.concat(F.lit("conflict/"), F.md5(F.concat_ws("|", F.lit(kind), *[F.col(k) for k in ("pair", *keys)])))
    text = F.concat(F.lit(f"{kind}: "), F.col("original_value"), F.lit(" -> "), F.col("reproduction_value"))
    return construct(
        conflicts,
        [(node, "rdf:type", F.lit(kind)), (node, "conflictType", F.lit(kind)), (node, "originalValue", F.col("original_value")), (node, "reproductionValue", F.col("reproduction_value")), (node, "severity", F.lit(severity)), (node, "message", text)],
    )


def summary(named: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """kind, rows, conflicts (distinct nodes) and triples for each (conflict rows, triples)."""
    out = None
    for kind, (rows, triples) in named.items():
        a = rows.agg(F.count("*").alias("n_rows")).withColumn("kind", F.lit(kind))
        b = triples.agg(F.count_distinct("s").alias("n_conflicts"), F.count("*").alias("n_triples")).withColumn("kind", F.lit(kind))
        one = a.join(b, "kind").select("kind", "n_rows", "n_conflicts", "n_triples")
        out = one if out is None else out.unionByName(one)
    return out
