"""Embedding near-dedup by collision counting on one-dimensional projections.

Unit vectors are projected on random directions. The projections of two vectors at the threshold
distance d differ by a normal amount of deviation d, so whether the value of one lies in a window
around the other's is a matter of chance that is known beforehand.

1. Tables. A table sorts its vectors by one projection after the other and cuts them at the median; what
   lies within half a window of the cut goes to both sides. Two vectors collide in a table if no cut
   parts them, which takes a difference greater than the window. The number of tables is calibrated from
   the chance of a cut (medians and densities come from counts over all vectors) so that a pair at the threshold
   collides in one at least with the wanted recall. Labels are cut as often as their size asks for, as
   long as this saves comparisons; each cell of a table is compared on its own.
2. Counting. In a cell vectors are sorted by further projections; a pair must lie in each other's
   query-centred windows as often as the binomial tail of pairs at the threshold demands.
3. Pairs that reach the count are verified by their cosine in double precision. A pair counts in the
   first cell that has both, and tasks report counts and local components, never pairs.

Equal vectors of a label are one vector with a weight. Cells with more vectors than a block are compared
block by block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, comb, erf, exp, log, log2, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprolens.llm.common import Stage, plain
from reprolens.llm.components import connected, roots

COSINE = 0.93
PROJECTIONS = 48
WINDOW = 1.0  # half width in a cell, over the distance at the threshold
MARGIN = 0.75  # whole width at a cut, over the distance at the threshold
RECALL = 0.9999  # of pairs at the threshold; closer ones have more
CELL = 2048  # vectors of a cell, about
BLOCK = 2048  # vectors in a block
SAMPLE = 4096  # vectors with which tests place cuts; the operator counts all
BIN, BINS = 1 / 64, 1024  # width and number of the bins in which projections are counted
DEEPEST = 40  # cuts of a table, at most
SPREAD = 64  # cells in which a vector lies on average, at most
SEED = 11


def least_collisions(projections: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that pairs at the threshold reach with the wanted probability."""
    p, below = erf(window / sqrt(2)), 0.0
    for count in range(projections + 1):
        below += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > 1 - recall:
            return count
    return 0


def directions(dim: int, projections: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, projections))


def linked(x: np.ndarray, y: np.ndarray, cosine: float = COSINE, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors of x and y that collide often enough and have at least the cosine."""
    a = directions(x.shape[1])
    half, least = WINDOW * sqrt(2 - 2 * cosine), least_collisions()
    px, py = x @ a, y @ a
    order = np.argsort(py, axis=0)
    values = np.take_along_axis(py, order, axis=0)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(y))[:, None], axis=0)
    rank = np.ascontiguousarray(rank.T.astype(np.uint16))
    low = np.stack([np.searchsorted(values[:, j], px[:, j] - half, side="left") for j in range(a.shape[1])]).astype(np.uint16)
    size = np.stack([np.searchsorted(values[:, j], px[:, j] + half, side="right") for j in range(a.shape[1])]).astype(np.uint16) - low
    found = []
    for at in range(0, len(x), rows):
        count = np.zeros((len(x[at : at + rows]), len(y)), dtype=np.uint8)
        for j in range(a.shape[1]):  # inside the window: rank - low is below its size, as unsigned numbers
            count += (rank[j][None] - low[j, at : at + rows, None]) < size[j, at : at + rows, None]
        i, k = np.nonzero(count >= least)
        ok = np.einsum("ij,ij->i", x[at + i], y[k]) >= cosine
        found.append((at + i[ok], k[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


# --- tables -------------------------------------------------------------------------------------


@dataclass
class Cuts:
    """Where tables cut: medians of the projections for each dimension and table; how many cuts and tables labels of a size need."""

    window: float
    medians: dict[int, np.ndarray]  # dimension -> tables x cuts
    side: float  # part of the vectors on one side of a cut, with the window
    loss: float  # chance that a cut parts a pair at the threshold
    recall: float

    def tables(self, cuts: int) -> int:
        return 1 if not cuts else ceil(log(1 - self.recall) / log(1 - (1 - self.loss) ** cuts))

    def cuts(self, wanted: int) -> int:
        """The number of cuts, up to the wanted one, that leaves the fewest comparisons."""
        fine = [n for n in range(wanted + 1) if (self.tables(n) * (2 * self.side) ** n <= SPREAD) or not n]
        return min(fine, key=lambda n: (self.tables(n) * (2 * self.side**2) ** n, n))

    def sides(self, x: np.ndarray, table: int, cuts: int) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the cuts, as bits, of which it lies on the low side only, and on the high side only."""
        p = x @ directions(x.shape[1], DEEPEST, SEED + 1 + table)[:, :cuts] - self.at(x.shape[1], table)[:cuts]
        bit = np.int64(1) << np.arange(cuts - 1, -1, -1, dtype=np.int64)
        return ((p < -self.window / 2) * bit).sum(axis=1), ((p > self.window / 2) * bit).sum(axis=1)

    def at(self, dim: int, table: int) -> np.ndarray:
        m = self.medians.get(dim)
        return m[table] if m is not None and table < len(m) else np.zeros(DEEPEST)


def projected(x: np.ndarray, deep: int) -> np.ndarray:
    """Counts of the projections of unit vectors by table, cut and bin."""
    a = np.concatenate([directions(x.shape[1], DEEPEST, SEED + 1 + t)[:, :deep] for t in range(SPREAD)], axis=1)
    counts, base = np.zeros(a.shape[1] * BINS, dtype=np.int64), np.arange(a.shape[1]) * BINS
    for at in range(0, len(x), 512):
        bins = np.clip(np.floor(x[at : at + 512] @ a / BIN) + BINS // 2, 0, BINS - 1).astype(np.int64)
        counts += np.bincount((bins + base).ravel(), minlength=len(counts))
    return counts.reshape(SPREAD, deep, BINS)


def _placed(counts: dict[int, np.ndarray], cosine: float, recall: float) -> Cuts:
    """Medians, and the greatest density there, from the counts of each dimension (the densities from the first four tables)."""
    distance = sqrt(2 - 2 * cosine)
    window = MARGIN * distance
    tail = 2 * (exp(-(MARGIN**2) / 2) / sqrt(2 * pi) - MARGIN * (1 - erf(MARGIN / sqrt(2))) / 2) * distance  # mean excess of a difference over the window
    medians, dense, near = {}, [0.4], []
    for dim, n in counts.items():
        total = n.sum(axis=2)
        upto = n.cumsum(axis=2)
        middle = (2 * upto >= total[:, :, None]).argmax(axis=2)
        medians[dim] = np.zeros((SPREAD, DEEPEST))
        medians[dim][:, : n.shape[1]] = (middle + 0.5 - BINS // 2) * BIN
        if total.max() <= 100:
            continue

        def density(half: float, n=n, total=total, middle=middle) -> np.ndarray:
            reach = ceil(half / BIN - 0.5)
            inside = np.abs(np.arange(BINS) - middle[:4, :, None]) <= reach
            return (n[:4] * inside).sum(axis=2) / total[:4] / ((2 * reach + 1) * BIN)

        dense += density(distance / 2).mean(axis=1).tolist()
        near += (density(window / 2).mean(axis=1) * window).tolist()
    side = 0.5 + (sum(near) / len(near) if near else 0.4 * window) / 2
    return Cuts(window, medians, side, min(0.9, max(dense) * tail), recall)


def place_cuts(vectors: list[np.ndarray], cosine: float, recall: float = RECALL) -> Cuts:
    """Cuts from unit vectors."""
    by: dict[int, list[np.ndarray]] = {}
    for v in vectors:
        by.setdefault(len(v), []).append(v)
    return _placed({dim: projected(np.stack(v), DEEPEST) for dim, v in by.items()}, cosine, recall)


def measured_cuts(stage: Stage, unit: DataFrame, counts: DataFrame, cosine: float, kind: str, recall: float = RECALL) -> Cuts:
    """Cuts from all vectors of the lengths that have a label of more than CELL; counts don't depend on the order of tasks.

    A label is worth cutting while a cut leaves less than half of the comparisons (side squared), so twice the
    binary logarithm of its cells is the deepest.
    """
    large = counts.filter(F.col("count") > CELL).groupBy("dim").agg(F.max("count").alias("most")).collect()  # a row for each length that is cut
    deep = {r.dim: min(DEEPEST, ceil(2 * log2(r.most / CELL)) + 1) for r in large}

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for dim, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim), pa.int32()), pa.array(at), pa.array(n.ravel()[at])], names=["dim", "at", "n"])
            held.clear()

        for b in frames:
            dims, raw = b.column(0).to_numpy(), b.column(1).to_pylist()
            for dim in sorted(set(dims.tolist()) & set(deep)):
                pick = np.flatnonzero(dims == dim)
                n = projected(_unit(b"".join(raw[i] for i in pick), len(pick), kind), deep[dim])
                held[dim] = held[dim] + n if dim in held else n
                if len(held) > 4:
                    yield from flush()
        yield from flush()

    found = {dim: np.zeros(SPREAD * n * BINS, dtype=np.int64) for dim, n in deep.items()}
    if deep:
        rows = unit.select("dim", "x").mapInArrow(run, "dim int, at long, n long").groupBy("dim", "at").agg(F.sum("n").alias("n"))
        rows = stage.write(rows, "projected")
        for dim in found:  # a length at a time: SPREAD tables x cuts x bins
            part = rows.filter(F.col("dim") == dim).select("at", "n").toPandas()
            found[dim][part["at"].to_numpy()] = part["n"].to_numpy()
    return _placed({dim: n.reshape(SPREAD, deep[dim], BINS) for dim, n in found.items()}, cosine, recall)


def cells(low: np.ndarray, high: np.ndarray, cuts: int) -> tuple[np.ndarray, np.ndarray]:
    """Vector and cell (a bit for each cut) of each cell that a vector lies in."""
    of, cell = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
    for j in range(cuts - 1, -1, -1):
        down, up = high[of] >> j & 1 == 0, low[of] >> j & 1 == 0
        of, cell = np.concatenate([of[down], of[up]]), np.concatenate([cell[down] << 1, cell[up] << 1 | 1])
    return of, cell


def _spread(cuts: Cuts, kind: str, whole: bool):
    """Rows of each cell: with the vector and its sides in all tables if ``whole``, else only the cell."""

    best = np.array([cuts.cuts(n) for n in range(DEEPEST + 1)])

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            if not b.num_rows:
                continue
            wanted = best[np.minimum(b.column(5).to_numpy(), DEEPEST)]
            dims = b.column(2).to_numpy()
            raw = b.column(3).to_pylist()
            for dim, n in sorted(set(zip(dims.tolist(), wanted.tolist(), strict=True))):
                pick = np.flatnonzero((dims == dim) & (wanted == n))
                x = _unit(b"".join(raw[i] for i in pick), len(pick), kind)
                sides = [cuts.sides(x, t, n) for t in range(cuts.tables(n))]
                masks = np.stack([np.stack(s, axis=1) for s in sides], axis=1).astype(np.int64)  # vectors x tables x 2
                for t, (low, high) in enumerate(sides):
                    of, cell = cells(low, high, n)
                    rows = b.take(pa.array(pick[of]))
                    columns = [rows.column(1), rows.column(2), pa.array(cell | t << DEEPEST, pa.int64())]
                    names = ["label", "dim", "cell"]
                    if whole:
                        columns += [rows.column(0), rows.column(3), rows.column(4), pa.array([masks[i].tobytes() for i in of], pa.binary())]
                        names += ["vec_id", "x", "weight", "sides"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


# --- vectors ------------------------------------------------------------------------------------


def _unit(raw: bytes, n: int, kind: str) -> np.ndarray:
    """Unit vectors in double precision from the bytes of n vectors."""
    x = np.frombuffer(raw, dtype=kind).astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _known(kind: str):
    """Vectors that can link (no null, zero, null or non-finite component) as bytes."""

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            keep, dims, raw = [], [], []
            for v in b.column(2).to_pylist():
                x = np.asarray(v, dtype=kind) if v and None not in v else np.zeros(0, dtype=kind)
                good = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                keep.append(good)
                if good:
                    dims.append(len(x))
                    raw.append(x.tobytes())
            rows = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), rows.column(3)], names=["vec_id", "label", "dim", "x", "weight"])

    return run


def _compare(cosine: float, kind: str, pairs: int = 1 << 18):
    def first_cell(a: np.ndarray, b: np.ndarray, cell: int) -> np.ndarray:
        """Whether the cell is the first that has both vectors; a, b: their sides, vectors x tables x 2."""
        table = cell >> DEEPEST
        together = ((a[:, : table + 1, 0] & b[:, : table + 1, 1]) | (a[:, : table + 1, 1] & b[:, : table + 1, 0])) == 0
        least = a[:, table, 1] | b[:, table, 1]  # the first common cell of this table: low where nothing speaks against it
        return ~together[:, :table].any(axis=1) & (least == cell & (1 << DEEPEST) - 1)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        cell, i, j = int(key[2]), int(key[3]), int(key[4])
        part = [frame[frame["own"] == n].sort_values("vec_id") for n in ((i, j) if i != j else (i,))]
        if any(p.empty for p in part):
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
        ids, weight = ([p[c].to_numpy(np.int64) for p in part] for c in ("vec_id", "weight"))
        x = [_unit(b"".join(p["x"]), len(p), kind) for p in part]
        sides = [np.frombuffer(b"".join(p["sides"]), dtype=np.int64).reshape(len(p), -1, 2) for p in part]
        a, b = linked(x[0], x[-1], cosine)
        if i == j:
            a, b = a[a != b], b[a != b]
        keep = [first_cell(sides[0][a[at : at + pairs]], sides[-1][b[at : at + pairs]], cell) for at in range(0, len(a), pairs)]
        keep = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
        a, b = a[keep], b[keep]
        if i == j:
            n, every = np.bincount(a, weights=weight[0][b], minlength=len(x[0])), ids[0]
        else:
            n, every = np.concatenate([np.bincount(a, weights=weight[1][b], minlength=len(x[0])), np.bincount(b, weights=weight[0][a], minlength=len(x[1]))]), np.concatenate(ids)
            b = b + len(x[0])
        order = np.argsort(every, kind="stable")  # so that a root is the smallest id
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = every[order][roots(len(every), place[a], place[b])[place]]
        return pd.DataFrame({"a": every, "b": root, "n": n.astype(np.int64)})[n > 0]

    return run


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vec_id.

    Vectors of unlike length, of unlike or null labels, and vectors that are null, empty, zero or have a
    null or non-finite component link with nothing. Rows that repeat a vec_id count once (the smallest
    by label and components); a null vec_id is kept and links with nothing. An empty table gives no rows.
    """
    stage = Stage(spark, "vectors")
    rows = plain(vectors, "vec_id", "label", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    rows = stage.write(rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding"), "rows")
    label = rows.schema["label"].dataType.simpleString()
    kind = "<f4" if "float" in rows.schema["embedding"].dataType.simpleString() else "<f8"
    # Equal vectors of a label, told by 128 bits of two hashes: the smallest id stands for all.
    same = ["label", "length", "h1", "h2"]
    named = rows.filter("vec_id is not null and label is not null and embedding is not null").select("vec_id", "label", "embedding", F.size("embedding").alias("length"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), F.reverse("embedding")).alias("h2"))
    once = named.groupBy(*same).agg(F.min(F.struct("vec_id", "embedding")).alias("v"), F.count("*").alias("weight"))
    once = stage.write(once.select(*same, "v.vec_id", "v.embedding", "weight"), "once")
    unit = stage.write(once.select("vec_id", "label", "embedding", "weight").mapInArrow(_known(kind), f"vec_id long, label {label}, dim int, x binary, weight long"), "unit")

    counts = stage.write(unit.groupBy("label", "dim").count(), "counts")
    cuts = measured_cuts(stage, unit, counts, cosine, kind)
    wanted = F.greatest(F.lit(0), F.ceil(F.log(F.col("count") / CELL) / -log(cuts.side))).cast("int") if cuts.side < 1 else F.lit(0)
    sizes = counts.select("label", "dim", wanted.alias("wanted"))
    sized = unit.join(sizes, ["label", "dim"]).select("vec_id", "label", "dim", "x", "weight", "wanted")
    cell = ["label", "dim", "cell"]
    big = sized.mapInArrow(_spread(cuts, kind, False), f"label {label}, dim int, cell long").groupBy(*cell).count().filter(F.col("count") > BLOCK)
    big = stage.write(big.select(*cell, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "big")
    spread = sized.mapInArrow(_spread(cuts, kind, True), f"label {label}, dim int, cell long, vec_id long, x binary, weight long, sides binary").join(big, cell, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    found = spread.select(*cell, "i", "j", "own", "vec_id", "x", "weight", "sides").groupBy(*cell, "i", "j").applyInPandas(_compare(cosine, kind), "a long, b long, n long")
    found = stage.write(found, "found")

    component = connected(stage, found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    first = unit.select("vec_id", "weight").join(links, F.col("vec_id") == F.col("a"), "left").join(component, F.col("vec_id") == F.col("id"), "left")
    first = first.select(F.col("vec_id").alias("rep"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    member = named.select("vec_id", *same).join(once.select(*same, F.col("vec_id").alias("rep")), same).select(F.col("vec_id").alias("member"), "rep").join(first, "rep")
    out = rows.select("vec_id").join(member, F.col("vec_id") == F.col("member"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.expr("vec_id <=> component_id"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: c::DOUBLE) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v),
e AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS component FROM embeddings UNION SELECT e.y, r.component FROM r JOIN e ON r.id = e.x),
c AS (SELECT id, min(component) AS component_id FROM r GROUP BY id),
n AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT c.id AS vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, c.id = c.component_id AS kept
FROM c LEFT JOIN n ON n.x = c.id
"""
