"""Results of reproduction runs: comparison with claims, failure taxonomy, blocker families, funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprolens.functions.text import facts, facts_match, holds, norm, plain
from reprolens.functions.values import classify_pair

# Commands that still hold a placeholder.
PLACEHOLDER = r"(?i)(/path/to|/path_to|path_to_|\$\{?checkpoint|<checkpoint|/your/|checkpoint[ _]path|/tmp/outdir|/path\b)"
# Labels of failed runs, the first whose phrases all occur in the lower-cased log; of alternatives (a tuple) one must.
FAILURES = (
    ("missing_system_dep:mujoco", ("mujoco",)),
    ("missing_tool:unzip", (("unzip: not found", "unzip: command not found"),)),
    ("dead_download:404", (("404 not found", "error 404"),)),
    ("dead_download:500", (("500 internal server error", "error 500"),)),
    ("gated_download:403", ("403", ("download", "drive.google", "usercontent"))),
    ("gpu_oom", ("out of memory",)),
    ("auth_ssh", (("host key verification", "git@github.com"),)),
    ("auth_ssh", ("permission denied", "publickey")),
    ("missing_dependency", ("no module named '",)),
    ("install_build_error", ("failed to build", "editable")),
    ("install_build_error", (("configuration error: `project`", "invalid pyproject.toml"),)),
    ("missing_file_or_data", ("no such file or directory",)),
)
OTHER_FAILURE = "run_error:other"
# Families of reasons that start with the first word; for skipped ones, that hold one of the words.
SKIP_FAMILIES = (
    ("mismatch", "repo/paper mismatch"),
    ("out-of-scale|beyond", "out of compute scale"),
    ("no claimed|no numeric", "no numeric claim"),
    ("hardware|throughput|processing time", "hardware-bound metric"),
    ("production", "production/online metric"),
    ("device|api", "external device/API"),
)
FAMILIES = (
    ("no_recipe$", "no documented recipe"),
    ("placeholder_recipe$", "placeholder recipe"),
    (r"recipe_missing \(run extract_recipes first\)$", "recipe not extracted"),
    ("missing_dependency", "missing python dependency"),
    ("missing_system_dep|missing_tool", "missing system dependency"),
    ("dead_download|gated_download", "dead/gated download (link rot)"),
    ("install_build_error", "broken install/build"),
    ("gpu_oom$", "GPU out of memory"),
    ("auth_ssh$", "auth/SSH clone"),
    ("missing_file", "missing data/file"),
    ("no_metric_in_log$", "ran, metric not parsed"),
    ("run_error", "run error (other)"),
)


def is_placeholder(command: Column) -> Column:
    return F.coalesce(command.rlike(PLACEHOLDER), F.lit(False))


def classify_failure(log: Column) -> Column:
    low, out = F.lower(log), None
    for label, phrases in FAILURES:
        test = F.lit(True)
        for phrase in phrases:
            either = F.lit(False)
            for word in (phrase,) if isinstance(phrase, str) else phrase:
                either = either | low.contains(word)
            test = test & either
        value = F.lit(label)
        if label == "missing_dependency":
            value = F.concat(F.lit(label + ":"), F.regexp_extract(log, "(?i)no module named '([^']+)'", 1))
            test = test & log.rlike("(?i)no module named '[^']+'")
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(OTHER_FAILURE)


def family(reason: Column) -> Column:
    low, out = F.lower(F.coalesce(reason, F.lit(""))), None
    skip = low.startswith("skip")
    for words, name in SKIP_FAMILIES:
        test = skip & low.rlike(words)
        out = F.when(test, name) if out is None else out.when(test, name)
    out = out.when(skip, "skipped (other)")
    for start, name in FAMILIES:
        out = out.when(low.rlike(f"^({start})"), name)
    return out.otherwise(F.coalesce(F.nullif(reason, F.lit("")), F.lit("-")))


def last_number_near(log: Column, metric: Column) -> Column:
    """The last number that follows the metric's first word within 20 other characters; null without one."""
    word = F.get(F.split(norm(metric), " "), F.lit(0))
    hits = F.regexp_extract_all(log, F.concat(F.lit(r"(?i)\Q"), word, F.lit(r"\E[^0-9\-]{0,20}(-?[0-9]+\.?[0-9]*)%?")), F.lit(1))
    return F.when(word != "", F.try_element_at(hits, F.lit(-1)))


def metrics_match(a: Column, b: Column) -> Column:
    """Of two ``facts``: names match, or one lower-cased name without blanks holds the other (three characters or more)."""
    return facts_match(a, b) | holds(a["bare"], b["bare"], 3)


def metric_match(a: Column, b: Column) -> Column:
    return metrics_match(facts(a), facts(b))


def compare(claims: DataFrame, obtained: DataFrame) -> DataFrame:
    """(study, pos, metric, value, split) on both sides: each claim with the first matching result, which others may use too."""
    # Of results alike in study, metric and split only the first can be taken, and claims alike in these take the same one.
    kind = ["study", "metric", "split"]
    once = obtained.groupBy(*kind).agg(F.min(F.struct(F.col("pos").alias("p"), F.col("value").alias("v"))).alias("hit"))
    b = once.select("study", facts(F.col("metric")).alias("y"), plain(F.col("split")).alias("t"), "hit")
    a = claims.select(*kind).distinct().select(*kind, facts(F.col("metric")).alias("x"), plain(F.col("split")).alias("s"))
    same = ((F.col("s") == "") | (F.col("t") == "") | (F.col("s") == F.col("t"))) & metrics_match(F.col("x"), F.col("y"))
    found = a.join(b, "study").filter(same).groupBy(*kind).agg(F.min("hit")["v"].alias("obtained"))
    found = found.select(*[F.col(c).alias(f"_{c}") for c in kind], "obtained")
    first = claims.join(found, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in kind], "left").select("study", F.col("pos").alias("claim"), "metric", F.col("value").alias("claimed"), "obtained")
    return first.withColumn("result", F.when(F.col("obtained").isNull(), "missing").otherwise(classify_pair(F.col("claimed"), F.col("obtained"))))


def status(pairs: DataFrame) -> DataFrame:
    """Of each study: run_failed without any result, reproduced if all claims are, partial if some are, else mismatch."""
    n, good, some = F.count("*"), F.count_if(F.col("result") == "reproduced"), F.count_if(F.col("result") != "missing")
    return pairs.groupBy("study").agg(n.alias("n_claims"), good.alias("n_reproduced"), F.when(some == 0, "run_failed").when(good == n, "reproduced").when(good > 0, "partial").otherwise("mismatch").alias("status"))


def tally(rows: DataFrame, key: str) -> DataFrame:
    """Counts and shares in percent, most frequent first; ties by name."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy())
    place = F.row_number().over(W.orderBy(F.desc("n"), key))
    return counted.select(key, "n", F.round(100 * F.col("n") / total, 1).alias("percent"), place.alias("place"))


def funnel(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """For each stage in order, how many rows reach it and all before, and the share of the stage before."""
    reached, counts = F.lit(True), []
    for name, test in stages.items():
        reached = reached & F.coalesce(test, F.lit(False))
        counts.append(F.count_if(reached).alias(name))
    one = rows.agg(*counts)
    entries = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("stage"), F.col(n).alias("n")) for i, n in enumerate(stages)])
    long = one.select(F.inline(entries))
    before = F.lag("n").over(W.orderBy("position"))
    return long.withColumn("percent", F.when(before > 0, F.round(100 * F.col("n") / before, 1)))
