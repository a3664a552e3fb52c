"""Corpus cleaning: filters with reasons, keep-first dedup, scores, tiers, quotas, keys, resumption."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprolens.operators.components import connected
from reprolens.sources.staging import Stage

FULL = 5  # least score of the full tier


def with_reason(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """drop_reason: the first rule, in order, that a row fails; null if it passes all."""
    out = None
    for name, test in rules.items():
        failed = ~F.coalesce(test, F.lit(False))
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return rows.withColumn("drop_reason", out)


def reasons(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return with_reason(rows, rules).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def keep_first(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key; rows with a null key all stay, in the tasks that read them.

    An aggregation, so that each task sends one row of a key however often it holds it; a key is sent as
    a 256-bit checksum if it is a string.
    """
    keyed = rows.withColumn("_k", key)
    if dict(keyed.dtypes)["_k"] == "string":
        keyed = keyed.withColumn("_k", F.sha2("_k", 256))
    first = keyed.filter("_k is not null").groupBy("_k").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*order)).alias("_first"))
    return first.select("_first.*").unionByName(keyed.filter("_k is null").drop("_k"))


def keep_first_two_keys(rows: DataFrame, first: str, second: str, order: str) -> DataFrame:
    """In order, drops a row whose first or second key a kept row before it had; keys of dropped rows don't count.

    Whether a row stays depends only on rows that its keys tie it to, so each tied group is folded on
    its own. Rows need an order that is unique; null keys tie nothing.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField("_group", LongType())])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[set, set] = set(), set()
        group = None
        for frame in frames:
            keep = []
            for g, a, b in zip(frame["_group"], frame[first], frame[second], strict=True):
                if g != group:
                    group, seen = g, (set(), set())
                drop = (a is not None and a in seen[0]) or (b is not None and b in seen[1])
                keep.append(not drop)
                if not drop:
                    seen[0].add(a)
                    seen[1].add(b)
            yield frame[keep]

    tied = ties(rows, first, second, order)
    dealt = tied.repartition("_group").sortWithinPartitions("_group", order)
    return dealt.mapInPandas(fold, schema).drop("_group")


def ties(rows: DataFrame, first: str, second: str, order: str) -> DataFrame:
    """_group: the smallest order value among rows that shared keys tie together.

    Each row is linked to the first row with its first key and to the first with its second; groups are the
    connected components of these links, so that rounds grow with the logarithm of a chain, and each is staged.
    """
    stage = Stage(rows.sparkSession, "ties")
    number = F.col(order).cast("long")
    links = []
    for key in (first, second):
        keyed = rows.filter(F.col(key).isNotNull()).select(number.alias("a"), F.col(key).alias("_key"))
        links.append(keyed.join(keyed.groupBy("_key").agg(F.min("a").alias("b")), "_key").select("a", "b"))
    found = connected(stage, links[0].unionByName(links[1]), "ties")
    return rows.join(found, number == F.col("id"), "left").select(*[rows[c] for c in rows.columns], F.coalesce("component", number).alias("_group"))


#: Hosts, languages and years that the corpus takes.
HOST, LANGUAGES, YEARS, LEAST_SCORE = "github.com", ("Python", "Jupyter Notebook", "unknown", ""), (19, 25), 3


def paper_rules(pdf: Column) -> dict[str, Column]:
    """Of papers: the address of a PDF is known."""
    return {"missing_pdf": F.coalesce(pdf, F.lit("")) != ""}


def repository_rules(repo: Column, env_files: Column, pdf_accessible: Column) -> dict[str, Column]:
    """Of repositories: an address, one of the three environment files (a map of name to whether it is there), a PDF that opens."""
    has = [F.coalesce(env_files[name], F.lit(False)) for name in ("Dockerfile", "environment.yml", "requirements.txt")]
    return {"missing_repo": F.coalesce(repo, F.lit("")) != "", "missing_env": has[0] | has[1] | has[2], "missing_pdf": F.coalesce(pdf_accessible, F.lit(False))}


def candidate_rules(repo: Column, arxiv_id: Column, archived: Column, language: Column, points: Column) -> dict[str, Column]:
    """Of candidates: on the host, from the years taken (an identifier that doesn't begin with two digits passes), not archived, in a language taken, with enough points."""
    year = F.substring(F.coalesce(arxiv_id, F.lit("")), 1, 2).try_cast("int")
    return {
        "host": F.coalesce(repo, F.lit("")).contains(HOST), "year": year.isNull() | year.between(*YEARS), "archived": ~F.coalesce(archived, F.lit(False)),
        "language": F.coalesce(language, F.lit("")).isin(*LANGUAGES), "score": points >= LEAST_SCORE,
    }


def first_passing(rows: DataFrame, rules: dict[str, Column], target: int, *order: Column) -> DataFrame:
    """The first ``target`` rows in order that pass all rules: each task offers that many."""
    return with_reason(rows, rules).filter("drop_reason is null").drop("drop_reason").orderBy(*order).limit(target)


def selected(rows: DataFrame, status: str, skipped: str = "skipped", key: str | None = None, only: str | None = None) -> DataFrame:
    """Rows that aren't skipped (null isn't), of one key if one is named."""
    out = rows.filter(~F.coalesce(F.col(status) == skipped, F.lit(False)))
    return out.filter(F.col(key) == only) if key and only else out


def score(**parts: tuple[Column, int]) -> Column:
    """Sum of the points of what holds."""
    out = F.lit(0)
    for test, points in parts.values():
        out = out + F.when(F.coalesce(test, F.lit(False)), points).otherwise(0)
    return out


def tier(points: Column) -> Column:
    return F.when(points >= FULL, "full").otherwise("build_only")


def quota(rows: DataFrame, points: str, order: str, full: int = 30, rest: int = 70) -> DataFrame:
    """By points, then order: up to ``full`` rows of the full tier; those beyond, and all others, share ``rest`` places."""
    rows = rows.withColumn("_full", tier(F.col(points)) == "full")
    # Only the first full + rest rows of either kind can get a place: each task offers that many, and the windows see no more.
    front = [rows.filter(F.col("_full") == side).orderBy(F.desc(points), order).limit(full + rest) for side in (True, False)]
    rows = front[0].unionByName(front[1])
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("_full").orderBy(F.desc(points), order))).withColumn("final_tier", F.when(F.col("_full") & (F.col("_n") <= full), "full").otherwise("build_only"))
    limit = F.when(F.col("final_tier") == "full", full).otherwise(rest)
    rows = rows.withColumn("_m", F.row_number().over(W.partitionBy("final_tier").orderBy(F.desc(points), order)))
    return rows.filter(F.col("_m") <= limit).drop("_full", "_n", "_m")


def keys(rows: DataFrame, pattern: str, *order: str) -> DataFrame:
    """study_key: numbers in order, as in study001. For small tables: numbering needs one order of all rows."""
    return rows.withColumn("study_key", F.format_string(pattern, F.row_number().over(W.orderBy(*order))))


def remaining(rows: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """Rows whose key no marker has."""
    return rows.join(done.select(*key).distinct(), list(key), "left_anti")


def seeded_order(key: Column, seed: int = 42) -> Column:
    """The same shuffle for the same seed, whatever the partitions: order by this."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def by_tier(rows: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """value and source: from the first table if it has the key at all, even with a null value; else from the second."""
    a = first.select(F.col(key).alias("_a"), F.col(value).alias("_va"), F.lit(True).alias("_ha"))
    b = second.select(F.col(key).alias("_b"), F.col(value).alias("_vb"), F.lit(True).alias("_hb"))
    out = rows.join(a, F.col(key) == F.col("_a"), "left").join(b, F.col(key) == F.col("_b"), "left")
    source = F.when(F.col("_ha"), "first").when(F.col("_hb"), "second").otherwise("none")
    return out.withColumn(value, F.when(F.col("_ha"), F.col("_va")).otherwise(F.col("_vb"))).withColumn("source_tier", source).drop("_a", "_b", "_va", "_vb", "_ha", "_hb")
