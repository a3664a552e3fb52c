"""Extraction quality: fuzzy one-to-one matching, precision and recall, grounding in the text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from reprolens.functions.text import NULLISH_EVALUATION, acronyms, clean, facts, facts_match, jaccard, norm, plain, tokens
from reprolens.functions.values import canonical

# Fields of the headline group and of the repository group; all are in the overall group.
HEADLINE = ("methods", "datasets", "parameters", "evaluation_results", "environment")
REPOSITORY = ("software", "random_seeds")
VALUED = ("evaluation_results",)  # fields whose values must be equal, too, even if not strict


def prf(rows: DataFrame, *key: str) -> DataFrame:
    """Sums of tp, fp, fn, and precision, recall and F1 (0 where undefined), rounded to three digits."""
    s = rows.groupBy(*key).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return s.select(*key, "tp", "fp", "fn", (tp + fn).alias("support"), F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(ratio(2 * p * r, p + r), 3).alias("f1"))


def macro_f1(rows: DataFrame, unit: str, *key: str) -> DataFrame:
    """Mean of the F1 of each unit."""
    per = prf(rows, unit, *key)
    return (per.groupBy(*key) if key else per.groupBy()).agg(F.round(F.avg("f1"), 3).alias("macro_f1"), F.count("*").alias("n_units"))


def groups(field: Column) -> Column:
    """The groups that a field counts for; they overlap."""
    return F.array_compact(F.array(F.lit("overall"), F.when(field.isin(*HEADLINE), "headline"), F.when(field.isin(*REPOSITORY), "repository")))


def by_group(rows: DataFrame) -> DataFrame:
    return prf(rows.withColumn("group", F.explode(groups(F.col("field")))), "group")


def greedy_match(gold: DataFrame, predicted: DataFrame, fuzzy: bool = True, strict: bool = False) -> DataFrame:
    """(study, field, pos, name[, extra, value]) on both sides: in gold order, each takes the first unused prediction that matches; tp, fp, fn per study and field.

    Names match fuzzily or as trimmed lower case; ``extra``, where there is one, must be equal (it tells the
    slots of an environment apart); so must the canonical ``value`` if strict or of a field in VALUED.

    Equal names are counted: each form matches as often as the side with fewer rows has it, whatever the order.
    Fuzzy ones are a fold over a study and field, which a task holds: its distinct names with their positions.
    There a position of a name is one item; rows that repeat both, or have no position, count in fp or fn only.
    """
    form = facts(F.col("name")) if fuzzy else plain(F.col("name"))

    def items(t: DataFrame, side: int) -> DataFrame:
        extra = plain(F.col("extra")) if "extra" in t.columns else F.lit("")
        value = F.when(F.lit(strict) | F.col("field").isin(*VALUED), F.coalesce(canonical(F.col("value")), F.lit(""))).otherwise("") if "value" in t.columns else F.lit("")
        return t.filter(plain(F.col("name")) != "").select("study", "field", F.lit(side).alias("side"), F.concat_ws("|", extra, value).alias("same"), form.alias("form"), F.col("pos").cast("long").alias("pos"))

    rows, key = items(gold, 0).unionByName(items(predicted, 1)), ["study", "field"]
    if not fuzzy:
        g, p = (F.count(F.when(F.col("side") == i, 1)) for i in (0, 1))
        counts = rows.groupBy(*key, "same", "form").agg(g.alias("g"), p.alias("p")).withColumn("tp", F.least("g", "p"))
        return counts.groupBy(*key).agg(F.sum("tp").alias("tp"), F.sum(F.col("p") - F.col("tp")).alias("fp"), F.sum(F.col("g") - F.col("tp")).alias("fn"))
    names = ["form.squeezed", "form.tokens", "form.acronyms"]
    forms = rows.select(*key, "side", "same", *names, "pos").groupBy(*key, "side", "same", "squeezed", "tokens", "acronyms").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("pos")).alias("at"))
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = StructType([*(rows.schema[k] for k in key), *(StructField(c, LongType()) for c in ("tp", "fp", "fn"))])
    return forms.repartition(width, *key).groupBy(*key).applyInArrow(_folded(to_arrow_schema(out)), out)


HELD = 1 << 25  # numbers of matching predictions (4 bytes each) that a task keeps; what exceeds them is found again when it is needed


class Forms:
    """Distinct names of a side: which of them match another name, as ``facts_match`` says, by lists of their tokens, acronyms and four-letter runs."""

    def __init__(self, forms: list[dict]):
        self.same, self.squeezed = [f["same"] for f in forms], [f["squeezed"] for f in forms]
        self.sizes = np.array([len(f["tokens"]) for f in forms])
        lists: list[dict] = [{}, {}, {}, {}]
        for i, f in enumerate(forms):
            name = f["squeezed"]
            parts = ([name], f["tokens"], set(f["acronyms"]), {name[j : j + 4] for j in range(len(name) - 3)})
            for held, words in zip(lists, parts, strict=True) if name else ():  # an empty normal form matches nothing
                for word in words:
                    held.setdefault(word, []).append(i)
        self.named, self.tokens, self.acronyms, self.runs = ({w: np.array(at, np.int32) for w, at in held.items()} for held in lists)
        groups: dict[str, list[int]] = {}
        for i, same in enumerate(self.same):
            groups.setdefault(same, []).append(i)
        self.alike = {same: np.array(at, np.int32) for same, at in groups.items()}

    def matching(self, f: dict) -> np.ndarray:
        """Numbers of the forms that match, in order."""
        name, none = f["squeezed"], np.zeros(0, np.int32)
        if not name or f["same"] not in self.alike:
            return none
        ok = np.zeros(len(self.same), bool)
        for word in f["acronyms"]:
            ok[self.acronyms.get(word, none)] = True
            ok[self.named.get(word, none)] = True
        ok[self.acronyms.get(name, none)] = True
        ok[self.named.get(name, none)] = True
        if f["tokens"]:
            both = np.bincount(np.concatenate([none, *(self.tokens[t] for t in f["tokens"] if t in self.tokens)]), minlength=len(ok))
            ok |= (self.sizes > 0) & (3 * both >= self.sizes + len(f["tokens"]))
        runs = [self.runs.get(name[j : j + 4], none) for j in range(len(name) - 3)]
        if runs:
            for i in min(runs, key=len).tolist():  # names that hold this one have all of its runs
                ok[i] |= name in self.squeezed[i]
            near = np.bincount(np.concatenate(runs), minlength=len(ok))  # names within this one have all of theirs here
            for i in np.flatnonzero(near).tolist():
                if not ok[i]:
                    ok[i] = self.squeezed[i] in name
        at = self.alike[f["same"]]
        return at[ok[at]]


def _folded(schema: pa.Schema):
    none = np.iinfo(np.int64).max

    def run(table: pa.Table) -> pa.Table:
        forms = table.select(["side", "same", "squeezed", "tokens", "acronyms", "n", "at"]).to_pylist()
        gold, said = ([f for f in forms if f["side"] == i] for i in (0, 1))
        for side in (gold, said):
            side.sort(key=lambda f: (f["same"], f["squeezed"], f["tokens"], f["acronyms"]))
        index = Forms(said)
        head = np.array([f["at"][0] if f["at"] else none for f in said], np.int64)
        used, held, kept, tp = [0] * len(said), {}, 0, 0
        order = np.concatenate([np.zeros(0, np.int64), *(np.full(len(f["at"]), i) for i, f in enumerate(gold))])
        at = np.concatenate([np.zeros(0, np.int64), *(np.array(f["at"], np.int64) for f in gold)])
        for i in order[np.lexsort((order, at))].tolist():
            fits = held.get(i)
            if fits is None:
                fits = index.matching(gold[i])
                kept += len(fits)
                if kept <= HELD:
                    held[i] = fits
            if not len(fits):
                continue
            k = int(fits[head[fits].argmin()])
            if head[k] == none:
                held[i] = fits[:0]  # all are used
                continue
            tp += 1
            used[k] += 1
            head[k] = said[k]["at"][used[k]] if used[k] < len(said[k]["at"]) else none
        n = [sum(f["n"] for f in side) for side in (gold, said)]
        return pa.Table.from_arrays([*(table.column(c).slice(0, 1).cast(schema.field(c).type) for c in schema.names[:2]), *(pa.array([v], pa.int64()) for v in (tp, n[1] - tp, n[0] - tp))], schema=schema)

    return run


def name_grounded(name: Column, text: Column) -> Column:
    """The name's normal form occurs in the text's, or six of ten of its tokens do, or an acronym does."""
    t = tokens(name)
    body = F.concat(F.lit(" "), norm(text), F.lit(" "))
    words = F.split(norm(text), " ")
    share = F.when(F.size(t) > 0, F.size(F.array_intersect(t, words)) / F.size(t)).otherwise(0.0)
    return F.when(norm(name) == "", F.lit(False)).otherwise(body.contains(F.concat(F.lit(" "), norm(name), F.lit(" "))) | (share >= 0.6) | F.arrays_overlap(acronyms(name), words))


def grounding(names: DataFrame, texts: DataFrame, key: str, name: str, text_key: str, text: str, share: float = 0.6, block: int = 4096) -> DataFrame:
    """key, text_key of every name and text where ``name_grounded`` holds; keys are unique, each name and text is normalised once.

    Names are taken in blocks of about ``block``, indexed by word; a task looks each distinct word of a text
    up once and counts for each name that has it. Texts are read once for each block and never shuffled.
    """
    forms = names.select(F.col(key).alias("key"), norm(F.col(name)).alias("phrase"), tokens(F.col(name)).alias("tokens"), acronyms(F.col(name)).alias("acronyms")).filter("phrase != ''")
    blocks = max(1, -(-forms.count() // block))
    bodies = texts.select(F.col(text_key).alias("key"), norm(F.col(text)).alias("body"))
    found = StructType([StructField(key, names.schema[key].dataType), StructField(text_key, texts.schema[text_key].dataType)])
    parts = [bodies.mapInArrow(_grounded(forms.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i).collect(), share, found), found) for i in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _grounded(forms: list, share: float, found: StructType):
    index: dict[str, list[int]] = {}  # numbers of the names that have the word as a token
    short: dict[str, list[int]] = {}  # as an acronym
    for i, f in enumerate(forms):
        for word in f.tokens:
            index.setdefault(word, []).append(i)
        for word in f.acronyms:
            short.setdefault(word, []).append(i)
    lists = {word: np.array(at) for word, at in index.items()}
    sizes = np.array([len(f.tokens) for f in forms])
    phrases = [(i, f" {f.phrase} ") for i, f in enumerate(forms) if not f.tokens]  # with tokens, all of them are there if the phrase is

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            names, texts = [], []
            for text_key, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = set(body.split(" "))
                had = [lists[w] for w in words if w in lists]
                counts = np.bincount(np.concatenate(had), minlength=len(forms)) if had else np.zeros(len(forms), dtype=np.int64)
                hits = set(np.flatnonzero((sizes > 0) & (counts / np.maximum(sizes, 1) >= share)).tolist())
                hits.update(i for w in words if w in short for i in short[w])
                hits.update(i for i, phrase in phrases if phrase in f" {body} ")
                names += [forms[i].key for i in sorted(hits)]
                texts += [text_key] * len(hits)
            schema = to_arrow_schema(found)
            yield pa.RecordBatch.from_arrays([pa.array(names, schema[0].type), pa.array(texts, schema[1].type)], schema=schema)

    return run


def value_grounded(value: Column, text: Column) -> Column:
    """A number of two or more characters in the value occurs in the text."""
    numbers = F.filter(F.regexp_extract_all(value, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda n: F.length(n) >= 2)
    return F.exists(numbers, lambda n: F.contains(text, n))


def set_f1(gold: DataFrame, predicted: DataFrame, key: str, name: str) -> DataFrame:
    """Existential match both ways (two semi-joins): precision over predictions, recall over gold, F1."""
    g, p = gold.select(key, F.col(name).alias("a")).distinct(), predicted.select(key, F.col(name).alias("b")).distinct()
    pairs = g.withColumn("x", facts(F.col("a"))).join(p.withColumn("y", facts(F.col("b"))), key).filter(facts_match(F.col("x"), F.col("y")))
    hits = pairs.groupBy(key).agg(F.count_distinct("a").alias("hit_a"), F.count_distinct("b").alias("hit_b"))
    out = g.groupBy(key).agg(F.count("*").alias("n_gold")).join(p.groupBy(key).agg(F.count("*").alias("n_pred")), key, "full").join(hits, key, "left").fillna(0)
    precision = F.when(F.col("n_pred") > 0, F.col("hit_b") / F.col("n_pred")).otherwise(0.0)
    recall = F.when(F.col("n_gold") > 0, F.col("hit_a") / F.col("n_gold")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return out.select(key, "n_gold", "n_pred", F.round(precision, 3).alias("precision"), F.round(recall, 3).alias("recall"), F.round(f1, 3).alias("f1"))


def recipe_scores(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """key and the five recipe metrics of every key that both tables have: has_command, entry_point_hit, command_jaccard, dataset_f1, metric_f1.

    Both have run_command, requires_dataset (name) and produces_metric (metric); gold has entry_point.
    """
    words = lambda x: F.array_distinct(F.regexp_extract_all(plain(x), F.lit("[a-z0-9_./-]+"), F.lit(0)))
    names = lambda x, field: F.transform(F.filter(F.transform(F.coalesce(x, F.array().cast("array<struct<name:string,download:string>>") if field == "name" else F.array().cast("array<struct<metric:string,dataset:string>>")), lambda e: e[field]), lambda n: F.coalesce(n, F.lit("")) != ""), facts)
    columns = lambda t, side: t.select(F.col(key).alias(f"{side}_key"), F.col("run_command").alias(f"{side}_command"), names(F.col("requires_dataset"), "name").alias(f"{side}_data"), names(F.col("produces_metric"), "metric").alias(f"{side}_metric"), *([plain(F.col("entry_point")).alias("entry")] if side == "g" else []))
    both = columns(gold, "g").join(columns(predicted, "p"), F.col("g_key") == F.col("p_key"))

    def f1(p: Column, g: Column) -> Column:
        hit = lambda a, b: F.size(F.filter(a, lambda x: F.exists(b, lambda y: facts_match(x, y)))) / F.size(a)
        precision, recall = hit(p, g), hit(g, p)
        some = F.when(precision + recall > 0, F.round(2 * precision * recall / (precision + recall), 3)).otherwise(0.0)
        return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(some)

    return both.select(
        F.col("g_key").alias(key), (F.coalesce("p_command", F.lit("")) != "").alias("has_command"), ((F.col("entry") != "") & F.contains(plain(F.col("p_command")), F.col("entry"))).alias("entry_point_hit"),
        F.round(jaccard(words(F.col("p_command")), words(F.col("g_command"))), 3).alias("command_jaccard"), f1(F.col("p_data"), F.col("g_data")).alias("dataset_f1"), f1(F.col("p_metric"), F.col("g_metric")).alias("metric_f1"),
    )


def recipe_averages(scores: DataFrame) -> DataFrame:
    """n_studies and the mean of each recipe metric."""
    means = [F.round(F.avg(F.col(c).cast("double")), 3).alias(c) for c in ("has_command", "entry_point_hit", "command_jaccard", "dataset_f1", "metric_f1")]
    return scores.agg(F.count("*").alias("n_studies"), *means)


def step_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two command strings as token sets."""
    split = lambda x: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"\s+"), lambda t: t != ""))
    return jaccard(split(a), split(b))


def gold_fields(rows: DataFrame) -> DataFrame:
    """Ground truth (study_id, entities) to long rows study, field, pos, name, extra, value of the seven common fields."""
    parts = _lists(rows, "study_id", {
        "software": ("entities.SoftwareApplication", "name", "version"), "datasets": ("entities.Dataset", "name", None), "methods": ("entities.Method", "name", None),
        "parameters": ("entities.Parameter", "name", "value"), "random_seeds": ("entities.RandomSeed", "value", None), "evaluation_results": ("entities.EvaluationResult", "metric", "value"),
    })
    first = F.get("entities.ComputingEnvironment", F.lit(0))
    return _all(parts, _slots(rows, "study_id", gpu_model=first["gpu"], cuda_version=first["cuda"]))


def predicted_fields(rows: DataFrame) -> DataFrame:
    """Extraction records (study_id, metadata) to the same long rows."""
    parts = _lists(rows, "study_id", {
        "software": ("metadata.dependencies", "name", "version"), "datasets": ("metadata.datasets", "name", None), "methods": ("metadata.methods", "name", None),
        "parameters": ("metadata.hyperparameters", "name", "value"), "random_seeds": ("metadata.random_seeds", "", None), "evaluation_results": ("metadata.evaluation_results", "metric", "value"),
    })
    return _all(parts, _slots(rows, "study_id", gpu_model=F.col("metadata.hardware.gpu_model"), cuda_version=F.col("metadata.hardware.cuda_version")))


def _known(x: Column) -> Column:
    return clean(x.cast("string"), NULLISH_EVALUATION)


def _lists(rows: DataFrame, key: str, fields: dict[str, tuple]) -> list[DataFrame]:
    """One table for each field: path of the list, its name ("": the item itself) and its value; nameless items are left out."""
    parts = []
    for field, (path, name, value) in fields.items():
        one = rows.select(F.col(key).alias("study"), F.posexplode(path).alias("pos", "x"))
        pick = lambda c: F.lit(None).cast("string") if c is None else _known(F.col(f"x.{c}" if c else "x"))
        parts.append(one.select("study", F.lit(field).alias("field"), "pos", pick(name).alias("name"), F.lit("").alias("extra"), pick(value).alias("value")).filter("name is not null"))
    return parts


def _slots(rows: DataFrame, key: str, **slots: Column) -> DataFrame:
    """The environment: a row for each slot that is known, with the slot in ``extra``."""
    entries = F.array(*[F.struct(_known(x).alias("name"), F.lit(n).alias("extra")) for n, x in slots.items()])
    one = rows.select(F.col(key).alias("study"), F.posexplode(entries).alias("pos", "x"))
    return one.select("study", F.lit("environment").alias("field"), "pos", "x.name", "x.extra", F.lit(None).cast("string").alias("value")).filter("name is not null")


def _all(parts: list[DataFrame], *more: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [*parts, *more])


def pair_up(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Every key of the gold table with whether there is a prediction for it (else it is skipped)."""
    said = predicted.select(key).distinct().withColumn("_said", F.lit(True))
    return gold.select(key).distinct().join(said, key, "left").select(key, F.when(F.col("_said"), "evaluated").otherwise("skipped").alias("status"))
