"""Document extraction: sections, word windows, retrieval, model output repair, first-wins merging."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

SIZE, OVERLAP, LEAST = 200, 25, 30  # words of a window, shared with the next, at least
LONGEST = 200  # lines of a section without an end
# Headings (trimmed, lower case) that start and end the section on methods.
START = r"(^[0-9][.\s]+(experimental\s+setup|experimental\s+design|implementation\s+details?|methodology|methods?|experiments?|setup\s+and\s+implementation))|experimental\s+setup|implementation\s+details?|methodology"
END = r"(^[0-9][.\s]+(results?|evaluation|conclusion|discussion|related\s+work))|(^(references|bibliography|acknowledgements?))"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def chunks(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """key, pos, n_words, chunk: overlapping word windows; windows below the least number of words are dropped."""
    rows = docs.select(F.col(key), words(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    windows = F.transform(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(size - overlap)), lambda i: F.slice("_w", i + 1, size))
    out = rows.select(key, F.posexplode(windows).alias("pos", "_c"))
    return out.select(key, "pos", F.size("_c").alias("n_words"), F.array_join("_c", " ").alias("chunk")).filter(F.col("n_words") >= least)


def section(text: Column, start: str = START, end: str = END) -> Column:
    """(first, last, found): line numbers of the section between the first heading and the first end after it.

    If it has 100 words or fewer, or there is no heading: the middle half of the lines, not found.
    """
    lines = F.split(text, r"\r?\n")
    marks = F.transform(lines, lambda x: F.struct((F.trim(F.lower(x)).rlike(start)).alias("a"), (F.trim(F.lower(x)).rlike(end)).alias("z")))
    first = F.array_position(F.transform(marks, lambda m: m["a"]), F.lit(True)) - 1
    after = F.filter(F.transform(marks, lambda m, i: F.when(m["z"] & (i > first), i)), lambda i: i.isNotNull())
    last = F.coalesce(F.try_element_at(after, F.lit(1)), F.least(first + LONGEST, F.size(lines)))
    body = F.when(first >= 0, F.array_join(F.slice(lines, F.greatest(first, F.lit(0)).cast("int") + 1, F.greatest(last - first, F.lit(0)).cast("int")), "\n")).otherwise("")
    good = (first >= 0) & (F.size(words(body)) > 100)
    quarter = F.floor(F.size(lines) / 4)
    return F.struct(F.when(good, first).otherwise(quarter).cast("int").alias("first"), F.when(good, last).otherwise(quarter * 3).cast("int").alias("last"), good.alias("found"))


def embed(rows: DataFrame, text: str, make: Callable[[], Callable[[list[str]], Any]], column: str = "embedding") -> DataFrame:
    """The rows with an embedding (array of float) of their text. ``make`` builds the model once for each task; it takes a list of texts. Null texts count as empty."""
    schema = StructType([*rows.schema.fields, StructField(column, ArrayType(FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            model = model or make()
            if len(frame):
                frame[column] = [np.asarray(v, dtype=np.float32) for v in model(frame[text].fillna("").tolist())]
                yield frame

    return rows.mapInPandas(run, schema)


def hashed_words(dim: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A model without weights: signed counts of hashed words, of unit length."""

    def make() -> Callable[[list[str]], np.ndarray]:
        def model(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % dim] += 1 if h >> 31 else -1
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

        return model

    return make


def top_k(vectors: DataFrame, queries: DataFrame, key: str, embedding: str, k: int, block: int = 4096) -> DataFrame:
    """query, key, score, place: the k vectors with the greatest cosine for each query; ties by key.

    Queries are taken in blocks of about ``block``, so that what every task gets is bounded however many
    there are. A task keeps the k best it has met for each query of the block; only these are shuffled.
    Vectors and queries that are null, zero, or hold null or non-finite components have no cosine;
    vectors of another length than the query don't, either.
    """
    kind = vectors.schema[key].dataType
    found = StructType([StructField("query", queries.schema[key].dataType), StructField(key, kind), StructField("score", DoubleType())])
    asked = queries.select(F.col(f"`{key}`").alias("key"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    blocks = max(1, -(-asked.count() // block))
    given = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    best = None
    for i in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i).collect()  # one block
        part = given.mapInArrow(_best_of(rows, k, found), found)
        best = part if best is None else best.unionByName(part)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), key))
    return best.withColumn("place", place).filter(F.col("place") <= k)


def _units(keys: list, vectors: list) -> dict[int, tuple[list, np.ndarray]]:
    """By length: keys and unit vectors, in the order of the keys."""
    by: dict[int, tuple[list, list]] = {}
    for key, v in zip(keys, vectors, strict=True):
        if v and None not in v:
            x = np.asarray(v, dtype=np.float64)
            n = np.sqrt(x @ x)
            if np.isfinite(n) and n > 0:
                ids, held = by.setdefault(len(x), ([], []))
                ids.append(key)
                held.append(x / n)
    out = {}
    for size, (ids, held) in by.items():
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
        out[size] = [ids[i] for i in order], np.stack([held[i] for i in order])
    return out


def _best_of(rows: list, k: int, found: StructType, width: int = 1024):
    """A task that keeps, for each of the given queries, the k best vectors it meets."""
    asked = _units([r.key for r in rows], [r.x for r in rows])

    def better(old: list[tuple], score: np.ndarray, ids: list) -> list[tuple]:
        least = -np.partition(-score, k - 1)[k - 1] if len(score) > k else -np.inf
        new = old + [(-score[j], ids[j]) for j in np.flatnonzero(score >= least).tolist()]
        return sorted(new, key=lambda e: (e[0], e[1] is None, e[1]))[:k]

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {size: [[] for _ in ids] for size, (ids, _) in asked.items()}  # (negative score, key) of the best
        for frame in frames:
            for at in range(0, frame.num_rows, width):
                b = frame.slice(at, width)
                for size, (ids, x) in _units(b.column(0).to_pylist(), b.column(1).to_pylist()).items():
                    if size not in asked:
                        continue
                    score = np.round(asked[size][1] @ x.T, 6)
                    floor = np.array([-best[-1][0] if len(best) == k else -np.inf for best in held[size]])
                    for q in np.flatnonzero(score.max(axis=1) >= floor).tolist():
                        held[size][q] = better(held[size][q], score[q], ids)
        out = [(query, name, -float(s)) for size, best in held.items() for query, entries in zip(asked[size][0], best, strict=True) for s, name in entries]
        schema = to_arrow_schema(found)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def distinct_passages(rows: DataFrame, text: str, *order: str, prefix: int = 100) -> DataFrame:
    """The first of the passages that begin alike."""
    place = F.row_number().over(W.partitionBy(F.substring(text, 1, prefix)).orderBy(*order))
    return rows.withColumn("_n", place).filter("_n = 1").drop("_n")


def first_wins(rows: DataFrame, unit: str, key: Column, value: Column, *order: str) -> DataFrame:
    """unit, key, value: of the entries with one normal key, the first in order."""
    keyed = rows.select(unit, key.alias("key"), value.alias("value"), F.struct(*order).alias("_o")).filter("key is not null")
    return keyed.groupBy(unit, "key").agg(F.min_by("value", "_o").alias("value"))


def first_known(rows: DataFrame, unit: str, values: dict[str, Column], *order: str) -> DataFrame:
    """For each unit and slot the first value that isn't null."""
    o = F.struct(*order)
    return rows.groupBy(unit).agg(*[F.min_by(v, F.when(v.isNotNull(), o)).alias(name) for name, v in values.items()])


_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")


def repair_json(text: str | None) -> str:
    """A JSON object from model output: fences and prose around it are cut, open strings and brackets closed; "{}" if nothing helps."""
    if not text:
        return "{}"
    body = _FENCE.sub("", text.strip())
    start = body.find("{")
    if start < 0:
        return "{}"
    stack, quoted, escaped, end = [], False, False, None
    for i, c in enumerate(body[start:], start):
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            if not stack:
                end = i + 1
                break
    attempts = [body[start:end]] if end else [re.sub(r"[,:\s]+$", "", body[start:] + '"' * quoted) + "".join(reversed(stack))]
    for attempt in attempts:
        try:
            found = json.loads(attempt)
        except ValueError:
            continue
        if isinstance(found, dict):
            return json.dumps(found, sort_keys=True)
    return "{}"


def repaired(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(repair_json)

    return run(text)


def extract(passages: DataFrame, text: str, schema: str, make: Callable[[], Callable[[str], dict]]) -> DataFrame:
    """Runs an extractor over passages; ``make`` builds the client once for each task. Errors of one passage give nulls for it."""
    names = passages.columns

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for frame in frames:
            found = pd.DataFrame([call(t) or {} for t in frame[text]], index=frame.index)
            out = frame.copy()
            for column in fields:
                out[column] = found[column] if column in found else None
            yield out[[*names, *fields]]

    fields = [x.strip().split(" ")[0] for x in schema.split(",")]
    return passages.mapInPandas(run, ", ".join([*(f"`{n}` {passages.schema[n].dataType.simpleString()}" for n in names), schema]))


def complete(rows: DataFrame, prompt: Column, make: Callable[[], Callable[[str], str]], column: str = "answer") -> DataFrame:
    """The rows with a model's answer to their prompt. ``make`` builds the client once for each task; an error of one row gives null."""
    asked = rows.withColumn(column, prompt)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for frame in frames:
            client = client or make()

            def answer(text: str) -> str | None:
                try:
                    return client(text)
                except Exception:  # noqa: BLE001  whatever the client raises
                    return None

            frame[column] = [answer(t) if t is not None else None for t in frame[column]]
            yield frame

    return asked.mapInPandas(run, StructType([StructField(f.name, f.dataType) for f in asked.schema]))  # answers may be null


RECIPE_PROMPT = "Give the steps that reproduce the main result of this repository as one JSON object with the keys run_command, setup_steps, requires_dataset, requires_checkpoint, produces_metric, entry_point, confidence.\n\n"
METRIC_PROMPT = 'Give the metrics that this log reports as {"obtained": [{"metric": "", "value": "", "split": null}]}; leave out what is not in it. Wanted: '


def recipes(rows: DataFrame, text: str, paper: str | None, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """The rows with a recipe (as ``normalise_recipe``) that a model reads from a repository's documents and the first 4,000 characters of its paper."""
    prompt = F.concat(F.lit(RECIPE_PROMPT), F.coalesce(F.col(text), F.lit("")))
    if paper:
        prompt = F.concat(prompt, F.coalesce(F.concat(F.lit("\n\nFrom the paper:\n"), F.substring(paper, 1, 4000)), F.lit("")))
    return complete(rows, prompt, make).withColumn("recipe", normalise_recipe(F.coalesce(repaired(F.col("answer")), F.lit("{}")))).drop("answer")


def log_metrics(rows: DataFrame, log: str, claimed: Column, make: Callable[[], Callable[[str], str]], tail: int = 6000) -> DataFrame:
    """The rows with obtained metrics (metric, value, split) that a model reads from the end of a log; those without a value are left out."""
    wanted = F.coalesce(F.nullif(F.array_join(claimed, "; "), F.lit("")), F.lit("any"))
    prompt = F.concat(F.lit(METRIC_PROMPT), wanted, F.lit("\n\n"), F.coalesce(F.substring(log, -tail, tail), F.lit("")))
    found = F.from_json(F.coalesce(repaired(F.col("answer")), F.lit("{}")), "obtained array<struct<metric:string,value:string,split:string>>")["obtained"]
    found = F.coalesce(F.filter(found, lambda m: F.coalesce(m["value"], F.lit("")) != ""), F.from_json(F.lit("[]"), "array<struct<metric:string,value:string,split:string>>"))
    return complete(rows, prompt, make).withColumn("obtained", found).drop("answer")


def normalise_recipe(text: Column) -> Column:
    """Seven fields of a recipe given as JSON: single values become lists, absent commands null, other confidences "low"."""
    raw = F.from_json(text, "map<string,string>")
    value = lambda k: F.try_element_at(raw, F.lit(k))
    one = lambda k: F.when(~F.lower(F.trim(value(k))).isin(*NULLISH), F.trim(value(k)))

    def many(k: str, kind: str) -> Column:
        bare = value(k)
        return F.when(bare.startswith("["), F.from_json(bare, f"array<{kind}>")).when(one(k).isNotNull(), F.from_json(F.concat(F.lit("["), F.when(bare.startswith("{"), bare).otherwise(F.to_json(F.struct(bare.alias("name"), bare.alias("metric")))), F.lit("]")), f"array<{kind}>") if kind != "string" else F.array(bare)).otherwise(F.from_json(F.lit("[]"), f"array<{kind}>"))

    return F.struct(
        one("run_command").alias("run_command"), many("setup_steps", "string").alias("setup_steps"), many("requires_dataset", "struct<name:string,download:string>").alias("requires_dataset"), one("requires_checkpoint").alias("requires_checkpoint"),
        many("produces_metric", "struct<metric:string,dataset:string>").alias("produces_metric"), one("entry_point").alias("entry_point"), F.when(F.lower(value("confidence")).isin("high", "medium"), F.lower(value("confidence"))).otherwise("low").alias("confidence"),
    )


NULLISH = ("", "null", "none", "n/a", "na", "nan", "nil", "unknown", "not specified", "not reported", "not stated")


def joined_documents(rows: DataFrame, unit: str, name: str, rank: str, text: str, most: int = 16_000) -> DataFrame:
    """unit, text: a unit's files in the order of rank and name, each under its name, cut to ``most`` characters."""
    entry = F.struct(F.col(rank).alias("r"), F.col(name).alias("n"), F.substring(text, 1, most).alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.concat(F.lit("## "), x["n"], F.lit("\n"), x["t"]))
    return rows.groupBy(unit).agg(F.substring(F.array_join(parts, "\n\n"), 1, most).alias("text"))
