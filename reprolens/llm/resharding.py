"""Sharding by minimum-cost flow: fewest bytes move from old shards to new capacities.

Old shard sizes and new capacities form a small transport network (old shards x new shards, a fixed
number of nodes). The flow is solved on the driver; it never sees documents. Documents are then laid
out along each old shard in a fixed pseudo-random order, cut into hash blocks, and the flow's byte
ranges are mapped onto blocks: a block wholly inside a range moves as one, and only a block that a
range boundary crosses is split by documents.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprolens.llm.common import Stage, plain

SHARDS = 8  # new shards
OLD = 5  # shards of the layout that the query starts from
BLOCKS = 1024  # hash blocks of each old shard, at least
ROWS = 1 << 20  # rows of a block, about, at most: a block is ordered in one task


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Amounts moved from each supplier to each receiver at the least total cost (successive shortest paths with potentials).

    The capacities must hold the supply. Ties go to the receiver with the smaller number.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities don't hold the supply")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    source, sink, size = n + m, n + m + 1, n + m + 2
    height = [0] * size

    def arcs(u: int):
        if u == source:
            yield from ((i, 0, left[i]) for i in range(n) if left[i])
        elif u < n:
            yield from ((n + j, cost[u][j], 1 << 62) for j in range(m))
        elif u < n + m:
            j = u - n
            if room[j]:
                yield sink, 0, room[j]
            yield from ((i, -cost[i][j], flow[i][j]) for i in range(n) if flow[i][j])

    while any(left):
        far, back, heap = [None] * size, [None] * size, [(0, source)]
        far[source] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for v, c, room_uv in arcs(u):
                step = d + c + height[u] - height[v]
                if room_uv and (far[v] is None or step < far[v]):
                    far[v], back[v] = step, u
                    heapq.heappush(heap, (step, v))
        most = max(x for x in far if x is not None)
        height = [h + (most if x is None else x) for h, x in zip(height, far, strict=True)]
        path, v = [], sink
        while v != source:
            path.append((back[v], v))
            v = back[v]
        amount = min(next(r for w, _, r in arcs(u) if w == v) for u, v in path)
        for u, v in path:
            if u == source:
                left[v] -= amount
            elif v == sink:
                room[u - n] -= amount
            elif u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
    return flow


def plan(old_sizes: dict[int, int], shards: int, weights: list[int] | None = None) -> list[tuple[int, int, int, int]]:
    """(old shard, from, to, new shard) byte ranges along each old shard. Staying costs nothing, moving costs one a byte.

    ``weights`` shares the total among the new shards (equal ones by default).
    """
    weights = weights or [1] * shards
    total, all_weights = sum(old_sizes.values()), sum(weights)
    edge = [total * sum(weights[:i]) // all_weights for i in range(shards + 1)]
    capacity = [b - a for a, b in zip(edge, edge[1:], strict=False)]
    olds = sorted(old_sizes)
    cost = [[0 if o == j else 1 for j in range(shards)] for o in olds]
    flow = min_cost_flow([old_sizes[o] for o in olds], capacity, cost)
    out = []
    for o, row in zip(olds, flow, strict=True):
        at = 0
        for j in sorted(range(shards), key=lambda j: (j != o, j)):  # what stays comes first
            if row[j]:
                out.append((o, at, at + row[j], j))
                at += row[j]
    return out


def old_shard(olds: int = OLD) -> Column:
    """The layout to start from where none is given: a hash of doc_id over ``olds`` shards (null ids: shard 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(olds)), F.lit(0)).cast("int")


def _measures() -> tuple[Column, Column]:
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")


def assign(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, olds: int = OLD, blocks: int = BLOCKS, layout: str | None = None, weights: list[int] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot for each row.

    ``layout`` names a column of ``docs`` that holds the present shard of each row (null: shard 0); without
    one the rows lie as ``old_shard`` puts them. The present sizes are those of the rows in it. ``weights``
    are the capacities of the new shards, in proportion (equal by default). There are more blocks where
    the rows need them, so that no task orders more than about ROWS rows of ordinary size.
    Shard sizes differ from their capacities by about one document. Null text: size 1, checksum of no bytes. Repeated rows
    are rows of their own; rows alike in id and size are ordered by their checksum, and rows alike in
    that too are the same, so that any order gives the same result. An empty table gives no rows.
    """
    stage = Stage(spark, "reshard")
    old = F.coalesce(F.col(f"`{layout}`").cast("int"), F.lit(0)).alias("old_shard") if layout else old_shard(olds).alias("old_shard")
    sized = stage.write(docs.select("doc_id", *_measures(), old), "sized")
    blocks = max(blocks, -(-sized.count() // ROWS))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)).cast("int"))
    # A row for each old shard and block from here to the offsets: a few thousand, or one for ROWS / olds rows of docs.
    sums = sized.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("bytes").over(W.partitionBy("old_shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = stage.write(sums.withColumn("before", before), "blocks")
    sizes = {r.old_shard: r.bytes for r in sums.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect()}  # one row for each old shard
    moves = plan(sizes, shards, weights) if sizes else []
    inside = W.partitionBy("old_shard", "block").orderBy("doc_id", "size", "text_crc32")
    placed = sized.join(sums.select("old_shard", "block", "before"), ["old_shard", "block"])
    middle = F.col("before") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size") / 2
    target = F.lit(None).cast("int")
    for o, a, b, j in moves:  # olds * shards ranges
        target = F.when((F.col("old_shard") == o) & (middle >= a) & (middle < b), F.lit(j)).otherwise(target)
    placed = stage.write(placed.withColumn("shard", target), "placed")
    counts = stage.write(placed.groupBy("shard", "old_shard", "block").count(), "counts")  # at most twice the blocks
    ahead = F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(counts.withColumn("ahead", ahead).drop("count"), ["shard", "old_shard", "block"])
    rank = F.row_number().over(W.partitionBy("shard", "old_shard", "block").orderBy("doc_id", "size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("ahead") + rank - 1).cast("long").alias("slot"))


def rewrite(docs: DataFrame, assigned: DataFrame, path: str) -> list[int]:
    """Writes the new shards that differ from the old ones under ``path`` (shard=N folders); returns their numbers.

    Each row is written once, whatever its id: rows alike in id, size and checksum are numbered on both
    sides (by their columns, and by their places) and paired by number. Columns ``shard`` and ``slot``
    are those of the assignment; if the rows have such columns, they are written as ``shard_given`` and ``slot_given``.
    """
    moved = assigned.filter("shard != old_shard")
    touched = sorted({r[0] for r in moved.select("shard").union(moved.select("old_shard")).distinct().collect()})  # shard numbers only
    alike = ["doc_id", "size", "text_crc32"]
    by_columns = [F.to_json(F.struct(F.col(f"row.`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"row.`{f.name}`") for f in docs.schema]
    given = docs.select("doc_id", *_measures(), F.struct("*").alias("row"))  # whatever else the rows have is in ``row``
    given = given.withColumn("copy", F.row_number().over(W.partitionBy(*alike).orderBy(*by_columns)))
    to = assigned.withColumn("copy", F.row_number().over(W.partitionBy(*alike).orderBy("shard", "slot"))).filter(F.col("shard").isin(touched))
    a, b = given.alias("a"), to.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*alike, "copy")]
    rows = a.join(b, same).select("row", F.col("b.shard").alias("to_shard"), F.col("b.slot").alias("to_slot"))
    rows = rows.repartitionByRange("to_shard", "to_slot").sortWithinPartitions("to_shard", "to_slot")
    columns = [F.col(f"row.`{c}`").alias(f"{c}_given" if c in ("shard", "slot") else c) for c in docs.columns]
    rows.select(*columns, F.col("to_shard").alias("shard"), F.col("to_slot").alias("slot")).write.mode("overwrite").partitionBy("shard").parquet(path)
    return touched


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = assign(spark, docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
