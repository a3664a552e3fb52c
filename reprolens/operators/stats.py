"""Statistics over studies: summaries by band, separation, concordance, rank correlation and rank sums, logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.errors import IllegalArgumentException, UnsupportedOperationException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEPARATED = 1e-6  # deviance below which a fit explains every label
DEPENDENT = 1e10  # condition of the features' correlations beyond which some depend on others

def summary(rows: DataFrame, key: str, value: str, digits: int = 4) -> DataFrame:
    v = F.col(value)
    aggregates = [F.count(v).alias("n"), F.round(F.avg(v), digits).alias("mean"), F.round(F.median(v), digits).alias("median"), F.min(v).alias("least"), F.max(v).alias("most")]
    return rows.groupBy(key).agg(*aggregates)


def separation(rows: DataFrame, band: str, value: str, high: str, low: str) -> DataFrame:
    """Least of the high band minus the most of the low one; null if either is empty."""
    top, bottom = F.min(F.when(F.col(band) == high, F.col(value))), F.max(F.when(F.col(band) == low, F.col(value)))
    return rows.agg(F.round(top - bottom, 4).alias("separation"))


def before(cells: DataFrame, value: str, n: str, *group: str, parts: int = 256) -> DataFrame:
    """before: the sum of ``n`` over smaller values of the group, for a table with a row for each group and value.

    Values are cut at approximate quantiles; sums of the parts (``parts`` rows at most for each group) give
    each part's start, so that no task orders more than a group's rows of one part.
    """
    from pyspark.ml.feature import Bucketizer

    cells = cells.withColumn("_v", F.col(value).cast("double"))
    cuts = sorted(set(cells.approxQuantile("_v", [i / parts for i in range(1, parts)], 0.5 / parts))) or [0.0]
    cut = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_v", outputCol="_part").transform(cells)
    sums = cut.groupBy(*group, "_part").agg(F.sum(n).alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_of"), start.alias("_start"))
    inside = F.coalesce(F.sum(n).over(W.partitionBy(*group, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    same = [F.col("_part") == F.col("_of"), *[F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]]
    out = cut.withColumn("_inside", inside).join(starts, same)
    return out.withColumn("before", F.col("_start") + F.col("_inside")).select(*[c for c in cells.columns if c != "_v"], "before")


def average_ranks(cells: DataFrame, value: str, rank: str, *group: str) -> DataFrame:
    """group, value, rank of each value among the rows of its group (``_n``: rows of a cell), ties at the mean of their places."""
    counted = cells.groupBy(*group, value).agg(F.sum("_n").alias("_rows"))
    return before(counted, value, "_rows", *group).select(*group, value, (F.col("before") + (F.col("_rows") + 1) / 2).alias(rank))


def spearman(rows: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    """Pearson correlation of average ranks over rows where both are known.

    Rows are counted by (group, x, y) first; ranks are computed for distinct values and joined to these
    cells, and the correlation is a weighted one, so that no task holds a group.
    """
    cells = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group, F.col(x).alias("_a"), F.col(y).alias("_b")).agg(F.count("*").alias("_n"))
    for value, rank in (("_a", "_x"), ("_b", "_y")):
        ranks = average_ranks(cells, value, rank, *group).select(*[F.col(g).alias(f"_of_{g}") for g in group], F.col(value).alias("_value"), rank)
        cells = cells.join(ranks, [F.col(value) == F.col("_value"), *[F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]]).drop("_value", *[f"_of_{g}" for g in group])
    n, u, v = F.col("_n").cast("double"), F.col("_x"), F.col("_y")
    sums = cells.groupBy(*group).agg(F.sum("_n").alias("n"), *[F.sum(n * e).alias(k) for k, e in (("sx", u), ("sy", v), ("sxx", u * u), ("syy", v * v), ("sxy", u * v))])
    m = F.col("n").cast("double")
    cross, spread = F.col("sxy") - F.col("sx") * F.col("sy") / m, [F.col(f"s{a}{a}") - F.col(f"s{a}") * F.col(f"s{a}") / m for a in "xy"]
    rho = F.when((spread[0] > 0) & (spread[1] > 0), cross / F.sqrt(spread[0] * spread[1]))
    return sums.select(*group, "n", F.round(rho, 6).alias("rho"))


def concordance(rows: DataFrame, band: str, value: str) -> DataFrame:
    """Of all pairs from different bands, the share that the value orders as the bands are; ties count half.

    Counted from ranks, not from pairs: rows are grouped by value and band, and running counts of each
    band give the pairs. ``band`` is a number, higher for better; values are few per band or not, the
    cost is a sort of distinct (band, value).
    """
    cells = rows.filter(F.col(band).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(band).alias("b"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    levels = cells.select(F.col("b").alias("b2")).distinct()  # bands are few
    below = cells.join(levels, F.col("b2") < F.col("b"))
    # For each cell and each lower band: rows of that band with a smaller and with an equal value.
    other = cells.select(F.col("b").alias("b2"), "v", F.col("n").alias("m"))
    merged = below.select("b", "b2", "v", "n", F.lit(0).alias("m")).unionByName(other.join(levels.select(F.col("b2").alias("b")), F.col("b2") < F.col("b")).select("b", "b2", "v", F.lit(0).alias("n"), "m"))
    merged = merged.groupBy("b", "b2", "v").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    order = W.partitionBy("b", "b2").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = merged.withColumn("less", F.sum("m").over(order) - F.col("m")).withColumn("all", F.sum("m").over(W.partitionBy("b", "b2")))
    return merged.agg(F.sum(F.col("n") * F.col("all")).cast("long").alias("n_pairs"), F.round(F.sum(F.col("n") * (F.col("less") + F.col("m") / 2)) / F.sum(F.col("n") * F.col("all")), 6).alias("concordance"))


def mann_whitney(rows: DataFrame, side: Column, value: str) -> DataFrame:
    """U of the first side (side true), both sizes, and the normal score with a tie correction."""
    cells = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(side).alias("a"), F.count("*").alias("n"))
    one = before(cells, "v", "n").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2).agg(F.sum("a").alias("n1"), F.sum(F.col("n") - F.col("a")).alias("n2"), F.sum(F.col("a").cast("double") * F.col("rank")).alias("r1"), F.sum(F.pow(F.col("n").cast("double"), F.lit(3)) - F.col("n")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, u = n1 + n2, F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return one.select("n1", "n2", u.alias("u"), F.round((u - n1 * n2 / 2) / spread, 6).alias("z"))


def varying(rows: DataFrame, columns: list[str]) -> list[str]:
    """Columns that take more than one value."""
    one = rows.agg(*[F.min(c).alias(f"a_{c}") for c in columns], *[F.max(c).alias(f"z_{c}") for c in columns]).first()
    return [c for c in columns if one[f"a_{c}"] != one[f"z_{c}"]]


def logit(rows: DataFrame, label: str, features: list[str], ridge: float = 1e-4) -> DataFrame:
    """term, coefficient, odds_ratio, p_value of a maximum-likelihood fit.

    A regularised fit without p-values where the features separate the labels (nothing is left to explain) or depend on each other.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    from pyspark.ml.stat import Correlation

    spark, used = rows.sparkSession, varying(rows, features)
    data = VectorAssembler(inputCols=used, outputCol="_x").transform(rows.dropna(subset=[label, *used]).select(F.col(label).cast("double").alias("_y"), *used))
    try:
        model = GeneralizedLinearRegression(featuresCol="_x", labelCol="_y", family="binomial", link="logit", tol=1e-12, maxIter=50).fit(data)
        alike = Correlation.corr(data, "_x").first()[0].toArray() if len(used) > 1 else np.eye(1)
        unsure = model.summary.deviance < SEPARATED or np.linalg.cond(alike) > DEPENDENT
        p = None if unsure else list(model.summary.pValues)  # there are none where columns depend on each other
    except (IllegalArgumentException, UnsupportedOperationException):
        p = None
    if p is None:
        model, p = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=ridge).fit(data), [None] * (len(used) + 1)
    else:
        p = [p[-1], *p[:-1]]  # the intercept comes last there
    terms = [("intercept", model.intercept), *zip(used, map(float, model.coefficients), strict=True)]
    out = spark.createDataFrame([(t, float(c), x) for (t, c), x in zip(terms, p, strict=True)], "term string, coefficient double, p_value double")
    return out.select("term", F.round("coefficient", 6).alias("coefficient"), F.round(F.exp("coefficient"), 6).alias("odds_ratio"), F.round("p_value", 6).alias("p_value"))
