"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words. Whole copies that every document of a source is certain to
get come first; for the rest, documents have unequal inclusion chances (growing with the root of
their size) and are ranked by random odds over inclusion odds. The sample is the front of that
ranking whose words come nearest to what is left of the target. The random number of a document is a
hash of its id, so that reruns agree. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprolens.llm.common import WORD_PATTERN, Stage, plain

WEIGHTS = (3, 1, 2)  # of the sources by code point, again and again, null last
SHARE = 1.5  # all targets together over all sizes
MOST = 2  # a source's target over its size, at most
BUCKETS = 4096  # of the ranking; only the bucket where the sample ends is put in order


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source_key, source_size, target: water filling over the sources, a table with a row for each.

    Sources fill in the order of the level at which each is full; below the final level they are full.
    """
    place = F.row_number().over(W.orderBy(F.col("source_key").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("full", most * F.col("source_size"))
    order = W.orderBy((F.col("full") / F.col("weight")), F.col("source_key").asc_nulls_last())
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    done = F.coalesce(F.sum("full").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("level", (total - done) / left)  # the level if this source and all after it aren't full
    t = t.withColumn("open", F.col("level") * F.col("weight") <= F.col("full"))
    level = F.min(F.when(F.col("open"), F.struct((F.col("full") / F.col("weight")).alias("at"), F.col("source_key").isNull().alias("last"), F.col("source_key"), F.col("level")))).over(everything)["level"]
    target = F.least(F.col("full").cast("double"), F.coalesce(level * F.col("weight"), F.col("full").cast("double")))
    return t.select("source_key", "source_size", target.alias("target"))


def rates(levels: DataFrame, goals: DataFrame) -> DataFrame:
    """rate_key, rate: chance of a document over its weight, such that the chances, at most 1 each, add up to the goal in words.

    Weights whose chance would pass 1 are certain, and the others share what is left: the rate is that of
    the greatest weight that stays within 1 once all greater ones are certain. None for sources without words.
    """
    before = W.partitionBy("source_key").orderBy(F.desc("w")).rowsBetween(W.unboundedPreceding, -1)
    certain, rest = F.coalesce(F.sum("words").over(before), F.lit(0)), F.col("ws") - F.coalesce(F.sum("weighed").over(before), F.lit(0))
    known = levels.join(goals.select("k", "ws", "goal"), F.expr("source_key <=> k")).withColumns({"certain": certain, "rest": rest}).filter("rest > 0")
    known = known.withColumn("rate", (F.col("goal") - F.col("certain")) / F.col("rest")).filter(F.col("rate") * F.col("w") <= 1)
    return known.groupBy(F.col("source_key").alias("rate_key")).agg(F.max_by("rate", "w").alias("rate"))


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0 to 2), taken for each row.

    Null text has size 0; sources that are null form one of their own, the last. Repeated rows are
    rows of their own and tie in the ranking; the tie goes by size, then any way, with the same
    result. A source without words has target 0 and its documents get no copy. An empty table gives
    no rows.
    """
    stage = Stage(spark, "mix")
    raw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|mix"))), 1, 13), 16, 10).cast("long")
    sized = plain(docs, "doc_id", "source", "text").select("doc_id", F.col("source").alias("source_key"), words(F.col("text")).alias("size"), ((raw + F.lit(0.5)) / F.lit(float(16**13))).alias("u"))
    sized = stage.write(sized.withColumn("w", F.floor(F.sqrt(F.col("size").cast("double")) * 1000).cast("long")), "sized")
    levels = stage.write(sized.groupBy("source_key", "w").agg(F.sum("size").alias("words"), F.sum(F.col("w") * F.col("size")).alias("weighed")), "levels")  # a row for each length of text in a source
    sums = levels.groupBy("source_key").agg(F.sum("words").alias("source_size"), F.sum("weighed").alias("ws"))
    goals = targets(sums.drop("ws")).join(sums.select(F.col("source_key").alias("k"), "ws"), F.expr("source_key <=> k")).drop("k")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.withColumn("base", F.floor(ratio).cast("int")).withColumn("part", ratio - F.floor(ratio))
    goals = goals.withColumn("goal", F.col("target") - F.col("base") * F.col("source_size"))
    goals = goals.withColumnRenamed("source_key", "k")
    goals = stage.write(goals.join(rates(levels, goals), F.expr("k <=> rate_key"), "left").drop("rate_key"), "goals")
    ranked = sized.join(goals, F.expr("source_key <=> k")).drop("k").withColumn("chance", F.when(F.col("rate").isNull(), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.col("rate") * F.col("w"))))
    odds = F.when(F.col("chance") >= 1.0, F.lit(0.0)).when(F.col("chance") <= 0.0, F.lit(float("inf"))).otherwise(F.col("u") / (1.0 - F.col("u")) * (1.0 - F.col("chance")) / F.col("chance"))
    ranked = ranked.withColumn("q", odds).withColumn("bucket", F.when(F.col("q") == float("inf"), F.lit(BUCKETS)).otherwise(F.floor(F.col("q") / (1.0 + F.col("q")) * BUCKETS)).cast("int"))
    ranked = stage.write(ranked.drop("ws", "w", "u", "rate"), "ranked")
    # A row for each source and bucket: the bucket in which the words reach the goal is the only one that needs an order.
    filled = ranked.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    filled = filled.withColumn("before", before).withColumnsRenamed({"source_key": "k", "bucket": "b"})
    ranked = ranked.join(filled, F.expr("source_key <=> k and bucket = b")).drop("k", "b")
    edge = (F.col("before") < F.col("goal")) & (F.col("before") + F.col("words") > F.col("goal"))
    order = W.partitionBy("source_key", "bucket").orderBy("q", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = F.col("before") + F.sum("size").over(order) - F.col("size") / 2
    whole = ranked.filter(~edge).withColumn("extra", (F.col("before") < F.col("goal")).cast("int"))
    split = ranked.filter(edge).withColumn("extra", (middle < F.col("goal")).cast("int"))
    copies = F.col("base") + F.col("extra")
    return whole.unionByName(split).select("doc_id", F.col("source_key").alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def take(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns and no others.

    Rows alike in id, source and size are alike for the mix, too: both sides number them and rows are
    paired by number, so that the words taken are those of ``mix`` even where ids repeat.
    """
    alike = ["id", "source", "size"]
    copies = mix(spark, docs).select(F.col("doc_id").alias("id"), "source", "size", "copies")
    copies = copies.withColumn("n", F.row_number().over(W.partitionBy(*alike).orderBy(F.desc("copies")))).filter("copies > 0")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source"), words(F.col("text")).alias("size"), F.struct("*").alias("row"))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy(*alike).orderBy(F.sha2(F.coalesce("row.text", F.lit("")), 256))))
    a, b = rows.alias("a"), copies.alias("b")
    both = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*alike, "n")])
    return both.select("a.row", F.explode(F.sequence(F.lit(1), F.col("b.copies"))).alias("copy")).select("row.*")


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(doc_id::VARCHAR || '|mix'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
e AS (SELECT *, floor(sqrt(size::DOUBLE) * 1000::DOUBLE)::BIGINT AS w FROM d),
l AS (SELECT source, w, sum(size)::BIGINT AS words, sum(w * size)::BIGINT AS weighed FROM e GROUP BY source, w),
s AS (SELECT source, sum(words)::BIGINT AS source_size, sum(weighed)::BIGINT AS ws FROM l GROUP BY source),
o AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS full_size FROM s),
p AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(full_size) OVER before_this, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before_this, 0))::DOUBLE AS lvl,
         full_size::DOUBLE / weight::DOUBLE AS full_at
  FROM o WINDOW before_this AS (ORDER BY full_size::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (SELECT q.lvl FROM p q WHERE q.lvl * q.weight <= q.full_size ORDER BY q.full_at, q.source NULLS LAST LIMIT 1) AS final_level FROM p),
t AS (SELECT source, source_size, ws, least(full_size::DOUBLE, coalesce(final_level * weight::DOUBLE, full_size::DOUBLE)) AS target FROM v),
g AS (
  SELECT *, floor(ratio)::BIGINT AS base, ratio - floor(ratio) AS part, target - floor(ratio) * source_size AS goal
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0::DOUBLE END AS ratio FROM t) r),
f AS (
  SELECT l.source, l.w, g.goal, coalesce(sum(l.words) OVER greater, 0) AS certain, g.ws - coalesce(sum(l.weighed) OVER greater, 0) AS rest
  FROM l JOIN g ON l.source IS NOT DISTINCT FROM g.source WINDOW greater AS (PARTITION BY l.source ORDER BY l.w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (
  SELECT source, arg_max(rate, w) AS rate FROM (SELECT source, w, (goal - certain::DOUBLE) / rest::DOUBLE AS rate FROM f WHERE rest > 0) x
  WHERE rate * w::DOUBLE <= 1 GROUP BY source),
c AS (
  SELECT e.doc_id, e.source, e.size, e.u, g.source_size, g.target, g.base, g.part, g.goal, CASE WHEN h.rate IS NULL THEN 0::DOUBLE ELSE least(1::DOUBLE, h.rate * e.w::DOUBLE) END AS chance
  FROM e JOIN g ON e.source IS NOT DISTINCT FROM g.source LEFT JOIN h ON h.source IS NOT DISTINCT FROM g.source),
r AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN chance >= 1 THEN 0::DOUBLE WHEN chance <= 0 THEN 'inf'::DOUBLE ELSE u / (1 - u) * (1 - chance) / chance END, doc_id, size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0::DOUBLE AS middle
  FROM c)
SELECT doc_id, size, source_size, target, ((base + CASE WHEN middle < goal THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
"""
