"""N-gram Jaccard join with several global token orders.

Two sets whose Jaccard similarity reaches the threshold share a token among the first few of each,
under every order of all tokens. Two orders are used; both put frequent tokens last (by a list of the
HEAVY heaviest tokens, a fixed length) and differ in the hash that orders the rest; any order gives
the same result, and these give short lists. Pairs must pass the prefix filter, with a bound on the overlap from the
number of shared prefix tokens, under each order; only then are whole sets compared.

Lists of a token with few sets give pairs. Longer lists never do: they tie their sets into groups.
Equal sets are compared once. Chains of shared passages can make a group large whose sets are not
alike; groups are therefore filtered twice more: first by prefixes under an order that puts the tokens of long lists
last, too (the lists tell their lengths exactly; the list of heavy tokens misses more of them as tables grow), then, what
still shares long lists, under the exact frequency order of its own tokens, rarest first: sets
that are mostly their own share no prefix token then, and what is left are groups of
near copies. Groups are compared in blocks of bounded size, by matrix products. All ways are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprolens.llm.common import U64, Stage, as_bytes, batches, mix, plain, rolling, signed, trim, width, word_hashes
from reprolens.llm.components import connected, roots

WORDS, PERCENT = 4, 85  # of a shingle; similarity in hundredths
HEAVY, LEAST = 1 << 19, 6  # most heavy tokens (16 bytes each, on the driver and in every task); documents in which a heavy token was seen, at least
CHUNK = 1 << 21  # tokens that a task counts at once when it looks for heavy ones
BATCH = 1 << 21  # bytes of text that a task turns into postings at once
SHORT = 32  # sets in a list that is turned into pairs
BLOCK = 1024  # sets in a block
SENT = 2_000_000  # most document ids (8 bytes each) that are sent to every task; more meet the texts in a shuffle, with the same result
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def shingles(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of k consecutive words, lower-cased A-Z; of all words if there are fewer; none without words."""
    h, at = word_hashes(texts, lower=True)
    runs = rolling(h, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(runs[a : b - k + 1]) if b - a >= k else rolling(h[a:b], b - a) ^ U64(b - a) if b > a else runs[:0])
    return out


def prefix(n, percent: int = PERCENT):
    """Length of the prefix of a set of n tokens."""
    return n - (percent * n + 99) // 100 + 1


def heavy_tokens(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes and frequencies of the heaviest tokens.

    Chunks of documents report what repeats within them; a frequency is the sum of the reports, which
    is the same for all who use it, and near the truth for tokens that are frequent enough to matter.
    """

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            held.clear()
            tokens.sort()  # in place
            at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            n = np.diff(at, append=len(tokens))
            return pa.RecordBatch.from_arrays([pa.array(signed(tokens[at[n > 1]])), pa.array(n[n > 1])], names=["token", "n"])

        for b in batches(frames, limit=BATCH):
            sets = shingles(as_bytes(b.column(0)), k)
            held += sets
            size += sum(map(len, sets))
            if size > CHUNK:
                yield flush()
                size = 0
        if size:
            yield flush()
        trim()

    found = plain(docs, "text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    rows = found.orderBy(F.desc("n"), "token").limit(HEAVY).toPandas().sort_values("token")  # HEAVY rows at most
    return np.stack([rows["token"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)])


POSTING = "kind int, token long, doc long, size long, heavy long"


def _weights(heavy: np.ndarray):
    """Weights of tokens: their frequency, 0 for those that aren't in the table."""
    known = heavy[0].view(U64)
    by_hash = np.argsort(known)
    known, often = known[by_hash], heavy[1][by_hash]

    def weigh(tokens: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
        return np.where(known[place] == tokens, often[place], 0) if len(known) else np.zeros(len(tokens), np.int64)

    return weigh


def _postings(heavy: np.ndarray, k: int, percent: int):
    """kind -1: a document (token: the first of the batch with the same set); 0, 1: light token of an order; 2, 3: a set tied to the
    first of the batch that shares a heavy token (token: that first one); 4, 5: heavy token of an order, with the batch's first set."""

    weigh = _weights(heavy)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, limit=BATCH):
            ids = b.column(0).to_pylist()
            sets = shingles(as_bytes(b.column(1)), k)
            first: dict[bytes, int] = {}
            rep, own = [], []
            for i, s in enumerate(sets):
                rep.append(first.setdefault(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), i) if len(s) and ids[i] is not None else i)
                if len(s) and rep[i] == i and ids[i] is not None:
                    own.append(i)
            yield _rows(np.full(len(ids), -1), [ids[r] for r in rep], ids, np.array([len(s) for s in sets]), np.zeros(len(ids), np.int64))
            if not own:
                continue
            doc_of = np.array([ids[i] for i in own], dtype=np.int64)
            sizes = np.array([len(sets[i]) for i in own])
            tokens = np.concatenate([sets[i] for i in own])
            owner = np.repeat(np.arange(len(own)), sizes)
            weight = weigh(tokens)
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for order, seed in enumerate(SEEDS):
                rank = np.lexsort((mix(tokens ^ U64(seed)), weight, owner))
                front = rank[np.arange(len(tokens)) - begin[owner] < prefix(sizes, percent)[owner]]
                many = weight[front] > 0
                heavies = np.bincount(owner[front], weights=many, minlength=len(own)).astype(np.int64)
                light = front[~many]
                o = owner[light]
                yield _rows(np.full(len(light), order), signed(tokens[light]), doc_of[o], sizes[o], heavies[o])
                if many.any():
                    t, o = tokens[front[many]], owner[front[many]]
                    _, at, back = np.unique(t, return_index=True, return_inverse=True)
                    tie = np.unique(np.stack([doc_of[o], doc_of[o[at]][back]], axis=1), axis=0)
                    tie = tie[tie[:, 0] != tie[:, 1]]
                    yield _rows(np.full(len(tie), 2 + order), tie[:, 1], tie[:, 0], np.zeros(len(tie), np.int64), np.zeros(len(tie), np.int64))
                    yield _rows(np.full(len(at), 4 + order), signed(t[at]), doc_of[o[at]], sizes[o[at]], np.zeros(len(at), np.int64))
        trim()

    return run


def _rows(*columns) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "token", "doc", "size", "heavy"])


LISTED = "kind int, x long, y long, need long"


def _lists(percent: int):
    """Rows sorted by kind and token: short lists give pairs (kind 0, 1), long and heavy ones tie each set to the first (kind 2, 3).
    Long ones report their token (x) and length (y), in parts if they are read in parts (kind 4).

    need: how many tokens a pair must share in the light part of its prefixes. What two sets share beyond both prefixes
    lies in the rest of the one whose prefix ends first; heavy tokens come last in a prefix and may all be shared.
    """

    def emit(kind: int, x: np.ndarray, y: np.ndarray, need: np.ndarray | None = None) -> pa.RecordBatch:
        need = np.zeros(len(x), np.int64) if need is None else need
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind), pa.int32()), *map(pa.array, (x, y, need))], names=[c.split()[0] for c in LISTED.split(", ")])

    def close(kind: int, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = ends - starts
        for n in np.unique(sizes[sizes <= SHORT]) if kind < 2 else ():
            if n < 2:
                continue
            block = part[starts[sizes == n][:, None] + np.arange(n)]  # lists x sets x columns
            i, j = np.triu_indices(int(n), 1)
            for at in range(0, len(block), max(1, 200_000 // len(i))):
                a, b = (block[at : at + max(1, 200_000 // len(i))][:, side].reshape(-1, 3) for side in (i, j))
                ok = (a[:, 0] != b[:, 0]) & (100 * np.minimum(a[:, 1], b[:, 1]) >= percent * np.maximum(a[:, 1], b[:, 1]))
                a, b = a[ok], b[ok]
                rest = np.maximum(a[:, 1] - prefix(a[:, 1], percent), b[:, 1] - prefix(b[:, 1], percent))
                need = -(-percent * (a[:, 1] + b[:, 1]) // (100 + percent)) - rest - np.minimum(a[:, 2], b[:, 2])
                yield emit(kind, np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 0], b[:, 0]), need)
        if kind < 2 and (sizes > SHORT).any():
            yield emit(4, tokens[sizes > SHORT], sizes[sizes > SHORT])
        for s, e in zip(starts[(sizes > SHORT) | (kind >= 2)].tolist(), ends[(sizes > SHORT) | (kind >= 2)].tolist(), strict=True):
            yield emit(2 + kind % 2, part[s:e, 0], np.full(e - s, part[s, 0]))

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_open, token_open, held, leader = None, None, [], None
        for b in frames:
            if not b.num_rows:
                continue
            kind, token = b.column(0).to_numpy(), b.column(1).to_numpy()
            data = np.stack([b.column(i).to_numpy() for i in (2, 3, 4)], axis=1)
            cut = np.flatnonzero((kind[1:] != kind[:-1]) | (token[1:] != token[:-1])) + 1
            edge = np.concatenate([[0], cut, [len(kind)]])
            ends = {0, len(edge) - 2}
            # Light lists that begin and end within this batch are closed below, many at once.
            for at in sorted(ends | set(np.flatnonzero(kind[edge[:-1]] >= 4).tolist())):
                k, t, part = int(kind[edge[at]]), int(token[edge[at]]), data[edge[at] : edge[at + 1]]
                if (k, t) != (kind_open, token_open):
                    if held:
                        yield from _finish(held, kind_open, token_open, close)
                    kind_open, token_open, held, leader = k, t, [], None
                if leader is None and sum(map(len, held)) + len(part) > 4 * SHORT:
                    joined = np.concatenate([*held, part])
                    leader, held = joined[0, 0], []
                    yield emit(2 + k % 2, joined[:, 0], np.full(len(joined), leader))
                    if k < 2:
                        yield emit(4, np.array([t]), np.array([len(joined)]))
                elif leader is not None:
                    yield emit(2 + k % 2, part[:, 0], np.full(len(part), leader))
                    if k < 2:
                        yield emit(4, np.array([t]), np.array([len(part)]))
                else:
                    held.append(part)
            if len(edge) > 3:
                s, e = edge[1:-2], edge[2:-1]
                for k in (0, 1):
                    mine = kind[s] == k
                    if mine.any():
                        yield from close(k, data, s[mine], e[mine], token[s[mine]])
        if held:
            yield from _finish(held, kind_open, token_open, close)
        trim()

    return run


def _finish(held: list[np.ndarray], kind: int, token: int, close) -> Iterator[pa.RecordBatch]:
    part = np.concatenate(held)
    yield from close(kind, part, np.array([0]), np.array([len(part)]), np.array([token]))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, limit=BATCH):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingles(as_bytes(b.column(1)), k)], pa.binary())], names=["doc", "tokens"])
        trim()

    return docs.mapInArrow(run, "doc long, tokens binary")


def _verify(percent: int):
    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, "tx", 1 << 24):
            keep = []
            for tx, ty in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(tx, U64), np.frombuffer(ty, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))
        trim()

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 512) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of 0/1 matrices over the tokens on both sides."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), dtype=np.float32)

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        ok = both[at] == flat if len(both) else np.zeros(len(flat), dtype=bool)
        order = np.argsort(at[ok], kind="stable")
        return row[ok][order], at[ok][order]

    (r1, c1), (r2, c2) = cells(left), cells(right)
    for at in range(0, len(both), columns):
        m = []
        for r, c, n in ((r1, c1, len(left)), (r2, c2, len(right))):
            a, b = np.searchsorted(c, [at, at + columns])
            x = np.zeros((n, columns), dtype=np.float32)
            x[r[a:b], c[a:b] - at] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


GROUP = ["g0", "g1", "part"]  # of a group: its components under both orders, and under the order of its own tokens


def _exploded(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g0, g1, doc, tokens to a row for each token."""
    for b in batches(frames, "tokens"):
        sets = [np.frombuffer(t, np.int64) for t in b.column(3).to_pylist()]
        sizes = np.array([len(s) for s in sets])
        at = np.repeat(np.arange(len(sets)), sizes)
        if len(at):
            rows = b.select([0, 1, 2]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(sets)), pa.array(sizes[at])], names=["g0", "g1", "doc", "token", "size"])
    trim()


def _parted(stage: Stage, front: DataFrame, percent: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Of prefix tokens (g0, g1, token, doc, size): pairs (x, y) from short lists, and smaller groups (doc, GROUP) from long ones."""
    group = ["g0", "g1"]
    lists = front.groupBy(*group, "token").agg(F.count("*").alias("n"), F.min("doc").alias("first")).filter("n > 1")
    listed = stage.write(front.join(lists, [*group, "token"]), f"{name}-listed")
    a = listed.filter(F.col("n") <= SHORT).select(*group, "token", F.col("doc").alias("x"), F.col("size").alias("m"))
    b = a.select(*group, "token", F.col("x").alias("y"), F.col("m").alias("o"))
    near = (F.col("x") < F.col("y")) & (100 * F.least("m", "o") >= percent * F.greatest("m", "o"))
    pairs = stage.write(a.join(b, [*group, "token"]).filter(near).select("x", "y").distinct(), f"{name}-near")
    ties = listed.filter(F.col("n") > SHORT).select(*group, F.col("doc").alias("a"), F.col("first").alias("b"))
    found = connected(stage, ties, f"{name}-again", *group)
    found = found.unionByName(found.select(*group, F.col("component").alias("id"), "component").distinct())
    return pairs, stage.write(found.select(F.col("id").alias("doc"), *group, F.col("component").alias("part")), f"{name}-regrouped")


def _fronts(known: np.ndarray, percent: int):
    weigh = _weights(known)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, "tokens", BATCH):
            sets = [np.frombuffer(t, U64) for t in b.column(3).to_pylist()]
            sizes = np.array([len(s) for s in sets])
            tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            rank = np.lexsort((mix(tokens ^ U64(SEEDS[0])), weigh(tokens), owner))
            front = rank[np.arange(len(tokens)) - (np.cumsum(sizes) - sizes)[owner] < prefix(sizes, percent)[owner]]
            if len(front):
                rows = b.select([0, 1, 2]).take(pa.array(owner[front]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(signed(tokens[front])), pa.array(sizes[owner[front]])], names=["g0", "g1", "doc", "token", "size"])
        trim()

    return run


def untie(stage: Stage, grouped: DataFrame, sets: DataFrame, known: np.ndarray, percent: int) -> tuple[DataFrame, DataFrame]:
    """As ``regroup``, under an order with the known tokens last, heaviest at the end: only prefixes become rows, and nothing is counted."""
    front = grouped.join(sets, "doc").select("g0", "g1", "doc", "tokens").mapInArrow(_fronts(known, percent), "g0 long, g1 long, doc long, token long, size long")
    return _parted(stage, stage.write(front, "prefixes"), percent, "long")


def regroup(stage: Stage, grouped: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of groups (doc, g0, g1): pairs (x, y) from short lists, and smaller groups (doc, GROUP) from long ones.

    Tokens are ordered by the number of the group's sets that have them. Linked sets share a token among
    the first few of each under this order too.
    """
    group = ["g0", "g1"]
    tokens = stage.write(grouped.join(sets, "doc").select(*group, "doc", "tokens").mapInArrow(_exploded, "g0 long, g1 long, doc long, token long, size long"), "tokens")
    often = tokens.groupBy(*group, "token").agg(F.count("*").alias("often"))
    place = F.row_number().over(W.partitionBy(*group, "doc").orderBy("often", F.xxhash64("token"), "token"))
    front = F.col("size") - F.floor((percent * F.col("size") + 99) / 100) + 1
    front = stage.write(tokens.join(often, [*group, "token"]).withColumn("place", place).filter(F.col("place") <= front).select(*group, "token", "doc", "size"), "front")
    stage.drop("tokens")
    return _parted(stage, front, percent, "exact")


def _sized(groups: DataFrame) -> DataFrame:
    """Groups with the number of blocks of each."""
    return groups.join(groups.groupBy(*GROUP).count().select(*GROUP, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), GROUP)


def _twins(sets: DataFrame) -> DataFrame:
    """a, b: each set that equals one of a document with a smaller id, and the smallest such id."""
    marked = sets.select("doc", F.sha2("tokens", 256).alias("sum"))
    first = marked.groupBy("sum").agg(F.min("doc").alias("b"), F.count("*").alias("n")).filter("n > 1").select("sum", "b")
    return marked.join(first, "sum").filter("doc != b").select(F.col("doc").alias("a"), "b")


def _blocks(percent: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[-2]), int(key[-1])
        part = [frame[frame["own"] == x] for x in ((i, j) if i != j else (i,))]
        sets = [[np.frombuffer(t, U64) for t in p["tokens"]] for p in part]
        if not all(sets):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        size = [np.array([len(s) for s in x], dtype=np.float64) for x in sets]
        both = overlaps(sets[0], sets[-1])
        x, y = np.nonzero(100 * both >= percent * (size[0][:, None] + size[-1][None] - both))
        ids = np.concatenate([p["doc"].to_numpy(np.int64) for p in part])
        root = roots(len(ids), x, y + (len(sets[0]) if i != j else 0))
        return pd.DataFrame({"a": ids, "b": ids[root]})[ids != ids[root]]

    return run


def components(spark: SparkSession, docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row.

    Null and empty texts, and texts of white space, have no shingles and are a component of their own,
    as are rows without a doc_id (their component is null). Rows that repeat a doc_id stand for one
    document with the texts of all. An empty table gives no rows.
    """
    stage = Stage(spark, "jaccard")
    docs = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    heavy = heavy_tokens(docs, k)
    stage.write(docs.mapInArrow(_postings(heavy, k, percent), POSTING), "all")
    rows = stage.read("all").filter("kind in (0, 1, 4, 5)").repartition(width(spark), "kind", "token").sortWithinPartitions("kind", "token")
    lists = stage.write(rows.mapInArrow(_lists(percent), LISTED), "lists")
    rows = stage.write(stage.read("all").filter("kind in (-1, 2, 3)"), "rows")
    stage.drop("all")
    stage.free()

    # Long lists: sets tied under an order have a common group of that order.
    order = (F.col("kind") - 2).alias("order")
    ties = lists.filter("kind in (2, 3)").select(order, F.col("x").alias("a"), F.col("y").alias("b"))
    ties = ties.unionByName(rows.filter("kind in (2, 3)").select(order, F.col("doc").alias("a"), F.col("token").alias("b")))
    found = connected(stage, ties, "ties", "order")
    found = found.unionByName(found.select("order", F.col("component").alias("id"), "component").distinct())
    group = stage.write(found.groupBy(F.col("id").alias("doc")).agg(*[F.max(F.when(F.col("order") == i, F.col("component"))).alias(f"g{i}") for i in (0, 1)]), "groups")

    # Short lists: a pair must share as many prefix tokens as it needs, under each order.
    counted = lists.filter("kind in (0, 1)").groupBy("x", "y").agg(*[F.count(F.when(F.col("kind") == i, 1)).alias(f"c{i}") for i in (0, 1)], *[F.max(F.when(F.col("kind") == i, F.col("need"))).alias(f"n{i}") for i in (0, 1)])
    counted = counted.withColumns({f"e{i}": F.coalesce(F.col(f"c{i}") >= F.col(f"n{i}"), F.lit(False)) for i in (0, 1)}).filter("e0 or e1")
    gx, gy = (group.select(F.col("doc").alias(x), F.col("g0").alias(f"{x}0"), F.col("g1").alias(f"{x}1")) for x in ("x", "y"))
    half = counted.filter("not (e0 and e1)").join(gx, "x").join(gy, "y").filter(" and ".join(f"(e{i} or x{i} = y{i})" for i in (0, 1)))
    pairs = stage.write(counted.filter("e0 and e1").select("x", "y").unionByName(half.select("x", "y")), "pairs")

    both = group.filter("g0 is not null and g1 is not null")
    grouped = stage.write(both.join(both.groupBy("g0", "g1").count().filter("count > 1").drop("count"), ["g0", "g1"]), "grouped")
    wanted = pairs.select(F.col("x").alias("doc")).union(pairs.select("y")).union(grouped.select("doc")).distinct()
    wanted = stage.write(wanted, "wanted")
    if wanted.count() <= SENT:  # else texts and ids meet by a shuffle
        wanted = F.broadcast(wanted)
    sets = stage.write(_sets(docs.join(wanted, docs["doc_id"] == wanted["doc"], "left_semi"), k), "sets")

    twins = stage.write(_twins(sets), "twins")
    long = lists.filter("kind = 4").groupBy(F.col("x").alias("token")).agg(F.sum("y").alias("n")).orderBy(F.desc("n"), "token").limit(HEAVY).toPandas()  # HEAVY rows at most
    known = np.concatenate([heavy, np.stack([long["token"].to_numpy(np.int64), long["n"].to_numpy(np.int64)])], axis=1)
    few, untied = untie(stage, grouped.join(twins, grouped["doc"] == twins["a"], "left_anti"), sets, known, percent)
    more, again = regroup(stage, untied.select("doc", F.col("part").alias("g0"), F.col("part").alias("g1")), sets, percent)
    pairs, grouped = pairs.unionByName(few).unionByName(more), _sized(again)

    sx, sy = (sets.select(F.col("doc").alias(x), F.col("tokens").alias(f"t{x}")) for x in ("x", "y"))
    links = pairs.join(sx, "x").join(sy, "y").select("x", "y", "tx", "ty").mapInArrow(_verify(percent), "a long, b long")
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    spread = grouped.join(sets, "doc").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    blocks = spread.select(*GROUP, "i", "j", "own", "doc", "tokens").groupBy(*GROUP, "i", "j").applyInPandas(_blocks(percent), "a long, b long")
    same = rows.filter("kind = -1 and token != doc").select(F.col("doc").alias("a"), F.col("token").alias("b"))
    component = connected(stage, links.unionByName(blocks).unionByName(same).unionByName(twins))
    base = rows.filter("kind = -1").select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"))
    return base.join(component, base["doc_id"] == component["id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 3), ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 3, 1))) AS i FROM w WHERE len(words) > 0) x),
n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * both_have >= 85 * (nx.n_shingles + ny.n_shingles - both_have)),
r AS (SELECT doc_id AS id, doc_id AS component FROM documents UNION SELECT e.y, r.component FROM r JOIN e ON r.id = e.x)
SELECT d.doc_id, coalesce(n.n_shingles, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(component) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id
"""
