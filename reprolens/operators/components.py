"""Connected components of links, by alternating star contractions; nothing is gathered on the driver but counts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from reprolens.sources.staging import Stage


def connected(stage: Stage, links: DataFrame, name: str = "links", *by: str) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``links`` (a, b) that isn't the smallest itself.

    Links that differ in the columns ``by`` belong to graphs of their own; these columns are returned, too.
    Each task first replaces the links of its partition by stars around the smallest ids that they reach.
    Each round then points neighbours at the smallest id around (large star, then small star), which keeps
    components and shortens paths; the number of rows never grows beyond that of the links. Rounds end
    when nothing changes. A null end links nothing; loops and repeated links don't matter.
    """
    u = [*by, "u"]
    now = links.select(*by, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    now = now.mapInArrow(_stars(to_arrow_schema(now.schema)), now.schema)
    now, seen, turn = stage.write(now, f"{name}-0"), None, 0
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*u, "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen or mark["n"] == 0:
            break
        seen = mark
        both = now.unionByName(now.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*u).agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, u).filter("v > u").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage.write(large, f"{name}-large")
        least = large.groupBy(*u).agg(F.min("v").alias("m"))
        small = large.join(least, u).filter("v != m").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(*u, F.col("m").alias("v")))
        turn += 1
        now = stage.write(small.filter("u != v").distinct(), f"{name}-{turn}")
        stage.drop(f"{name}-large")
        stage.drop(f"{name}-{turn - 1}")
    return now.select(*by, F.col("u").alias("id"), F.col("v").alias("component"))


def _stars(schema: pa.Schema):
    """Links (by, u, v) of a partition to (by, node, smallest node reachable within the partition)."""

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in frames if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        u, v = table.column(table.num_columns - 2), table.column(table.num_columns - 1)
        given, n = [table.column(i) for i in range(table.num_columns - 2)], table.num_rows
        if pa.types.is_int64(u.type) and all(pa.types.is_integer(c.type) for c in given):
            number, count = _numbered([c.to_numpy() for c in given], u.to_numpy(), v.to_numpy())
        else:  # ids of several parts: told apart and put in order as tuples
            ends = [[_plain(x) for x in c.to_pylist()] for c in (*given, u, v)]
            named = [*zip(*ends[:-2], ends[-2], strict=True), *zip(*ends[:-2], ends[-1], strict=True)]
            place = {x: i for i, x in enumerate(sorted(set(named)))}
            number, count = np.fromiter((place[x] for x in named), dtype=np.int64, count=2 * n), len(place)
        root = roots(count, number[:n], number[n:])
        # One row for each node that isn't its root: the first place at which the node, and its root, occur.
        first = np.full(count, -1, dtype=np.int64)
        first[number[::-1]] = np.arange(2 * n)[::-1]
        node = np.flatnonzero(root != np.arange(count))
        every = pa.chunked_array([*u.chunks, *v.chunks])
        columns = [*(c.take(pa.array(first[node] % n)) for c in given), every.take(pa.array(first[node])), every.take(pa.array(first[root[node]]))]
        yield from pa.Table.from_arrays(columns, schema=schema).to_batches()

    return run


def _numbered(given: list[np.ndarray], u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the nodes (given values and id) of both ends, in the order of the ids among equal values; how many there are."""
    code = np.zeros(len(u), dtype=np.int64)
    for column in given:
        values, inverse = np.unique(column, return_inverse=True)
        code = code * len(values) + inverse
        code = np.unique(code, return_inverse=True)[1]
    ids, code = np.concatenate([u, v]), np.concatenate([code, code])
    order = np.lexsort((ids, code))
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (code[order][1:] != code[order][:-1])
    number = np.empty(len(ids), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return number, int(new.sum())


def _plain(x):
    return tuple(x.values()) if isinstance(x, dict) else x


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes of a graph that one task holds."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
