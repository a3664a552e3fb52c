"""Substring dedup by compaction of a de Bruijn graph over token k-mers.

The graph's edges are runs of 20 words, its nodes the 19 words that two edges in a row share; only
edges that start at several places of the corpus are in it. An edge is named by its source coordinate,
the first place (doc_id, start) it starts at.

A transition of the graph is one that some document makes: the ways into and out of a node are counted
over edges that follow each other somewhere.

1. Seeds. Any 20 words hold one seed, the least hash among their 8-word runs. Only seeds of all
   documents are dealt out, and only repeated ones return to their documents.
2. Edges. Where a document has repeated seeds, the edges that contain them are dealt out by a 64-bit hash
   and a 32-bit check; each place but the first comes back with the source coordinate. Places in a row
   whose sources are in a row travel as one row: such edges follow each other in the graph, too.
3. Graph. The source coordinates of all repeated edges form stretches; where a document goes from one
   edge to another that isn't next at the source, a junction joins two edges. Joins of stretches with
   junctions give the degree of each node. Nonbranching paths are compacted: a stretch is cut where a
   node branches, and pieces that a junction without a branch joins are chained by connected components.
4. Spans. Every later place of a path is a span (start, words, source document, source start). Its words
   are compared with those at the source coordinates, by a digest of the words on both sides; only
   spans that agree are kept, and the words they cover are removed.

A task counts repeats within its own chunk of documents before anything is dealt, so the rows of a
very common seed or edge are bounded by the number of chunks. Texts are dealt once, into files by key;
each later step finds them there without another exchange.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprolens.llm.common import U64, Stage, as_bytes, batches, mix, plain, rolling, signed, width, word_hashes
from reprolens.llm.components import connected

K = 20  # words of an edge
SEED = 8  # words of a seed; each edge holds one of its K - SEED + 1 seeds
BUCKET = 1 << 25  # bytes of text of a task, about
LOT = 1 << 13  # runs with one source document that are dealt together, about
RUN = "doc long, start long, source_doc long, source_start long, count long"
_LONG = pa.int64()


def _least_in_window(h: np.ndarray, w: int) -> np.ndarray:
    """Index of the least of each w neighbours (the first of equals)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    index, value, size = np.arange(len(h)), h, 1
    while size < w:  # windows of ``size`` merge to twice that, or to w
        step = min(size, w - size)
        left, right = value[: len(value) - step], value[step:]
        take = right < left
        index, value = np.where(take, index[step:], index[: len(index) - step]), np.where(take, right, left)
        size += step
    return index[:n]


def _edges(raw: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, offsets of the texts' words, and for each edge: its position among all words, and its text."""
    h, at = word_hashes(raw)
    sizes = np.diff(at)
    n = np.maximum(0, sizes - k + 1)
    text = np.repeat(np.arange(len(raw)), n)
    before = np.concatenate([[0], np.cumsum(n)[:-1]])
    position = np.arange(int(n.sum())) - before[text] + at[:-1][text] if len(raw) else np.zeros(0, np.int64)
    return h, at, position, text


def _first_places(h: np.ndarray, doc: np.ndarray, start: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order by (hash, check, document, start), and for each place in it the index in the order of the first with the same hash."""
    keys = (start, doc, h) if check is None else (start, doc, check, h)
    order = np.lexsort(keys)
    new = np.ones(len(order), dtype=bool)
    new[1:] = h[order][1:] != h[order][:-1]
    if check is not None:
        new[1:] |= check[order][1:] != check[order][:-1]
    return order, np.flatnonzero(new)[np.cumsum(new) - 1]


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.astype(np.int64, copy=False), _LONG) for c in columns]


SEEDS = "known int, h long, doc long, at long"  # known: 0 no, 1 repeats in its chunk, 2 further place in its chunk


def _seed_task(k: int, m: int):
    """Seeds of a chunk: of each the first place is dealt by hash, the others are known to be repeated."""

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            raw, ids = as_bytes(b.column(1)), b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            h, at, position, _ = _edges(raw, k)
            if not len(position):
                continue
            short = rolling(h, m)
            seed = np.unique(_least_in_window(short, k - m + 1)[position])
            owner = np.searchsorted(at, seed, side="right") - 1
            order, first = _first_places(short[seed], ids[owner], seed)
            count = np.bincount(first, minlength=len(order))
            known = np.where(first == np.arange(len(order)), count[first] > 1, 2)
            place = (seed - at[owner])[order]
            yield pa.RecordBatch.from_arrays([pa.array(known, pa.int32()), *_longs(signed(short[seed][order]), ids[owner][order], place)], names=["known", "h", "doc", "at"])

    return run


EDGES = "kind int, a long, b long, c long, d long, e long"  # 0: hash, doc, check and start; 1: a run of further places in a chunk


def _edge_task(k: int, m: int):
    """Edges around repeated seeds: the first place in the chunk is dealt by hash, later ones refer to it."""

    def rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        n = len(columns[0])
        columns = [*columns, *[np.zeros(n, np.int64)] * (5 - len(columns))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), *_longs(*columns)], names=["kind", *"abcde"])

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            raw, ids = as_bytes(b.column(1)), b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            h, at, position, text = _edges(raw, k)
            if not len(position):
                continue
            short = rolling(h, m)
            marked = np.zeros(len(short), dtype=bool)
            places = b.column(2)
            owner = np.repeat(np.arange(len(raw)), places.value_lengths().to_numpy())
            marked[at[owner] + places.flatten().to_numpy()] = True
            keep = marked[_least_in_window(short, k - m + 1)[position]]
            position, text = position[keep], text[keep]
            if not len(position):
                continue
            edge = signed(rolling(h, k)[position])
            check = (rolling(mix(h ^ U64(0x5851F42D4C957F2D)), k)[position] >> U64(33)).astype(np.int64)
            doc, start = ids[text], position - at[:-1][text]
            order, first = _first_places(edge, doc, start, check)
            own = first == np.arange(len(order))
            lead, rest = order[own], order[~own]
            yield rows(0, edge[lead], doc[lead], check[lead] << 32 | start[lead])
            if len(rest):
                source = order[first[~own]]
                yield rows(1, *runs(doc[rest], start[rest], doc[source], start[source]))

    return run


def runs(doc: np.ndarray, start: np.ndarray, source_doc: np.ndarray, source_start: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Joins places, or runs of ``count`` of them, to the longest runs: document, start, source document, source start, edges.

    What starts where the one before ends, in the document and in its source, continues the run.
    """
    count = np.ones(len(doc), dtype=np.int64) if count is None else count
    order = np.lexsort((start, doc))
    doc, start, source_doc, source_start, count = (x[order] for x in (doc, start, source_doc, source_start, count))
    if not len(doc):
        return doc, start, source_doc, source_start, count
    new = np.ones(len(doc), dtype=bool)
    step = count[:-1]
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + step) | (source_doc[1:] != source_doc[:-1]) | (source_start[1:] != source_start[:-1] + step)
    a = np.flatnonzero(new)
    return doc[a], start[a], source_doc[a], source_start[a], np.add.reduceat(count, a)


def _glue(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places (sorted by document and start) to runs; the last run of a batch is carried into the next."""
    held = None

    def batch(columns: Iterable[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(_longs(*columns), names=[c.split()[0] for c in RUN.split(", ")])

    for b in frames:
        if not b.num_rows:
            continue
        part = [b.column(i).to_numpy() for i in range(4)]
        part.append(np.ones(b.num_rows, dtype=np.int64))
        if held is not None:
            part = [np.concatenate([x, y]) for x, y in zip(held, part, strict=True)]
        part = runs(*part)
        held = [c[-1:] for c in part]
        if len(part[0]) > 1:
            yield batch(c[:-1] for c in part)
    if held is not None:
        yield batch(held)


def _translate(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by document: first stretches (side 0) with their targets, then runs (side 1) whose sources lie there.

    Runs are cut where a stretch begins or ends; a part inside a stretch gets the stretch's target as its
    source, others keep theirs.
    """
    held = None  # stretches of the document that the last batch ended in
    for b in frames:
        if not b.num_rows:
            continue
        rows = np.stack([b.column(i).to_numpy() for i in range(7)], axis=1)  # at_doc, side, at, count, x_doc, x_start, salt
        if held is not None:
            rows = np.concatenate([held, rows])
        held = rows[(rows[:, 0] == rows[-1, 0]) & (rows[:, 6] == rows[-1, 6]) & (rows[:, 1] == 0)]
        rank = np.cumsum(np.concatenate([[0], (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 6] != rows[:-1, 6])])) << 34
        side = rows[:, 1] == 1
        m, r = rows[~side], rows[side]
        if not len(r):
            continue
        low, high = rank[~side] + m[:, 2], rank[~side] + m[:, 2] + m[:, 3]
        begin, end = rank[side] + r[:, 2], rank[side] + r[:, 2] + r[:, 3]
        bounds = np.unique(np.concatenate([low, high]))
        i, j = np.searchsorted(bounds, begin, side="right"), np.searchsorted(bounds, end, side="left")
        n = j - i + 1
        of = np.repeat(np.arange(len(r)), n)
        nth = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        padded = np.concatenate([bounds, [0]])
        lo = np.where(nth == 0, begin[of], padded[i[of] + nth - 1])
        hi = np.where(nth == n[of] - 1, end[of], padded[np.minimum(i[of] + nth, len(bounds))])
        at = np.searchsorted(low, lo, side="right") - 1
        inside = (at >= 0) & (lo < np.concatenate([high, [0]])[at]) if len(m) else np.zeros(len(lo), dtype=bool)
        shift = lo - begin[of]
        doc, start = r[of, 0], r[of, 2] + shift
        if len(m):
            doc, start = np.where(inside, m[at, 4], doc), np.where(inside, m[at, 5] + lo - low[at], start)
        yield pa.RecordBatch.from_arrays(_longs(r[of, 4], r[of, 5] + shift, doc, start, hi - lo), names=[c.split()[0] for c in RUN.split(", ")])


def translate(stage: Stage, found: DataFrame, stretches: DataFrame, n: int, name: str) -> DataFrame:
    """``found`` (runs) with sources that lie in a stretch (doc, start, count, to_doc, to_start) replaced by its target, cut where it begins or ends.

    Runs of a document that is the source of very many are dealt in lots of about LOT, each with the document's stretches.
    """
    lots = found.groupBy(F.col("source_doc").alias("hot")).count().filter(F.col("count") > LOT).select("hot", F.ceil(F.col("count") / LOT).cast("long").alias("lots"))
    lots = stage.write(lots, f"{name}-lots")  # a row for each LOT runs at most
    a = stretches.join(lots, F.col("doc") == F.col("hot"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("lots", F.lit(1)) - 1)))
    a = a.select(F.col("doc").alias("at_doc"), F.lit(0).cast("long").alias("side"), F.col("start").alias("at"), "count", F.col("to_doc").alias("x_doc"), F.col("to_start").alias("x_start"), "salt")
    b = found.join(lots, F.col("source_doc") == F.col("hot"), "left").withColumn("salt", F.pmod(F.xxhash64("doc", "start"), F.coalesce("lots", F.lit(1))))
    b = b.select(F.col("source_doc").alias("at_doc"), F.lit(1).cast("long").alias("side"), F.col("source_start").alias("at"), "count", F.col("doc").alias("x_doc"), F.col("start").alias("x_start"), "salt")
    return a.unionByName(b).repartition(n, "at_doc", "salt").sortWithinPartitions("at_doc", "salt", "side", "at").mapInArrow(_translate, RUN)


def stretches(found: DataFrame) -> DataFrame:
    """doc, start, count: the source coordinates of all repeated edges, as the longest stretches of edges in a row."""
    ends = found.select(F.col("source_doc").alias("doc"), F.col("source_start").alias("start"), (F.col("source_start") + F.col("count")).alias("end")).groupBy("doc", "start").agg(F.max("end").alias("end"))
    by = W.partitionBy("doc").orderBy("start")
    reach = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    cut = ends.withColumn("new", F.when(F.col("start") > reach, 1).otherwise(0)).withColumn("nth", F.sum("new").over(by))
    return cut.groupBy("doc", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc", "start", (F.col("end") - F.col("start")).alias("count"))


def junctions(found: DataFrame, sources: DataFrame) -> DataFrame:
    """a_doc, a_start, b_doc, b_start: pairs of edges that follow each other in some document, but not at the source of either."""
    own = sources.select("doc", "start", F.col("doc").alias("source_doc"), F.col("start").alias("source_start"), "count")
    by = W.partitionBy("doc").orderBy("start")
    after = F.lead(F.struct("start", "source_doc", "source_start")).over(by)
    last = F.col("source_start") + F.col("count") - 1
    seen = found.select(*own.columns).unionByName(own).withColumn("after", after).filter("after.start = start + count and not (after.source_doc = source_doc and after.source_start = source_start + count)")
    return seen.select(F.col("source_doc").alias("a_doc"), last.alias("a_start"), F.col("after.source_doc").alias("b_doc"), F.col("after.source_start").alias("b_start")).distinct()


def pieces(sources: DataFrame, joints: DataFrame) -> DataFrame:
    """doc, start, count, head, tail: stretches cut at the nodes that branch; head and tail: the piece begins or ends its stretch.

    Inside a stretch a node has the edge before and the edge after at the source; a junction that leaves
    the one or enters the other is a second way, so the node branches.
    """
    cuts = joints.select(F.col("a_doc").alias("doc"), (F.col("a_start") + 1).alias("start")).unionByName(joints.select(F.col("b_doc").alias("doc"), F.col("b_start").alias("start"))).distinct()
    marks = sources.select("doc", "start", (F.col("start") + F.col("count")).alias("end")).unionByName(cuts.select("doc", "start", F.lit(None).cast("long").alias("end")))
    marks = marks.groupBy("doc", "start").agg(F.max("end").alias("end"))
    by = W.partitionBy("doc").orderBy("start")
    marks = marks.withColumn("stretch_end", F.last("end", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))).filter("start < stretch_end")
    stop = F.least(F.col("stretch_end"), F.coalesce(F.lead("start").over(by), F.col("stretch_end")))
    out = marks.withColumn("stop", stop)
    return out.select("doc", "start", (F.col("stop") - F.col("start")).alias("count"), F.col("end").isNotNull().alias("head"), (F.col("stop") == F.col("stretch_end")).alias("tail"))


def paths(stage: Stage, parts: DataFrame, joints: DataFrame) -> DataFrame:
    """doc, start, count, path: each piece with the smallest piece of its nonbranching path.

    A junction from the last edge of a stretch to the first of one goes through a node whose degrees are
    the numbers of junctions that leave the one and enter the other; where both are one, the path goes on.
    """
    out = joints.groupBy("a_doc", "a_start").agg(F.count("*").alias("ways_out"))
    into = joints.groupBy("b_doc", "b_start").agg(F.count("*").alias("ways_in"))
    name = F.struct("doc", "start")
    tails = parts.filter("tail").select(F.col("doc").alias("a_doc"), (F.col("start") + F.col("count") - 1).alias("a_start"), name.alias("a"))
    heads = parts.filter("head").select(F.col("doc").alias("b_doc"), F.col("start").alias("b_start"), name.alias("b"))
    links = joints.join(out.filter("ways_out = 1"), ["a_doc", "a_start"]).join(into.filter("ways_in = 1"), ["b_doc", "b_start"]).join(tails, ["a_doc", "a_start"]).join(heads, ["b_doc", "b_start"])
    chain = connected(stage, links.select("a", "b"), "chain")
    return parts.withColumn("id", name).join(chain, "id", "left").select("doc", "start", "count", F.coalesce("component", "id").alias("path"))


DIGESTS = f"source boolean, {RUN}, digest long"


def _text_words(raw: bytes) -> tuple[bytes, np.ndarray]:
    """The words of a text joined by single spaces, and where each begins there (and one after the last ends, with its space)."""
    words = raw.split()
    return b" ".join(words), np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)])


def _digest_task(k: int):
    """A digest of the words of each wanted stretch of edges."""

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            wanted = b.column(2)
            entries = wanted.flatten()
            sizes = wanted.value_lengths().to_numpy()
            start, count = (entries.field(c).to_numpy() for c in ("start", "count"))
            digest, at = np.zeros(len(start), dtype=np.int64), 0
            for raw, n in zip(as_bytes(b.column(1)), sizes.tolist(), strict=True):
                text, begin = _text_words(raw)
                low = begin[start[at : at + n]].tolist()
                high = (begin[start[at : at + n] + count[at : at + n] + k - 1] - 1).tolist()
                digest[at : at + n] = [int.from_bytes(hashlib.blake2b(text[x:y], digest_size=8).digest(), "little", signed=True) for x, y in zip(low, high, strict=True)]
                at += n
            doc = np.repeat(b.column(0).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([entries.field("source"), pa.array(doc, _LONG), *(entries.field(c) for c in ("start", "source_doc", "source_start", "count")), pa.array(digest, _LONG)], names=["source", *(c.split()[0] for c in RUN.split(", ")), "digest"])

    return run


def verified(stage: Stage, texts: DataFrame, found: DataFrame, k: int, n: int) -> DataFrame:
    """The runs whose words are those at their source coordinates. Sources are first places and runs later ones, so none is both."""
    entry = F.struct(F.col("at_source").alias("source"), "start", "source_doc", "source_start", "count")
    here = found.withColumn("at_source", F.lit(False))
    nothing = F.lit(0).cast("long")
    there = found.select(F.col("source_doc").alias("doc"), F.col("source_start").alias("start"), "count").distinct().select("doc", "start", nothing.alias("source_doc"), nothing.alias("source_start"), "count", F.lit(True).alias("at_source"))
    wanted = here.unionByName(there).repartition(n, "doc").groupBy("doc").agg(F.collect_list(entry).alias("wanted"))  # stretches of one document
    digests = stage.write(texts.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(_digest_task(k), DIGESTS), "digests")
    source = digests.filter("source").select(F.col("doc").alias("source_doc"), F.col("start").alias("source_start"), "count", F.col("digest").alias("source_digest"))
    return digests.filter("not source").join(source, ["source_doc", "source_start", "count"]).filter("digest = source_digest").select(*found.columns)


KEPT = "doc long, n_words long, n_removed long, kept_sha256 string, kept string, paths array<struct<start:long,words:long,source_doc:long,source_start:long>>"
_PATHS = pa.list_(pa.struct([(n, _LONG) for n in ("start", "words", "source_doc", "source_start")]))


def _cut_task(k: int, digest_only: bool):
    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            rows, at = [], 0
            spans = b.column(2)
            entries, sizes = spans.flatten(), pc.fill_null(spans.value_lengths(), 0).to_numpy(zero_copy_only=False)
            columns = [entries.field(i).to_numpy(zero_copy_only=False) for i in range(entries.type.num_fields)]  # start, count, source document, source start
            for doc, raw, n in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), sizes.tolist(), strict=True):
                words = raw.split()
                total = len(words)
                mine = [c[at : at + n] for c in columns]
                at += n
                if n:
                    cover = np.zeros(total + 1, dtype=np.int64)
                    np.add.at(cover, mine[0], 1)
                    np.add.at(cover, mine[0] + mine[1] + k - 1, -1)
                    words = list(itertools.compress(words, (np.cumsum(cover[:-1]) == 0).tolist()))
                kept = b" ".join(words)
                listed = None
                if not digest_only:
                    listed = [dict(zip(("start", "words", "source_doc", "source_start"), (int(s), int(c) + k - 1, int(d), int(e)), strict=True)) for s, c, d, e in sorted(zip(*mine, strict=True))]
                rows.append((doc, total, total - len(words), hashlib.sha256(kept).hexdigest(), None if digest_only else kept.decode(), listed))
            kinds = (_LONG, _LONG, _LONG, pa.string(), pa.string(), _PATHS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc", "n_words", "n_removed", "kept_sha256", "kept", "paths"])

    return run


def dedup(spark: SparkSession, docs: DataFrame, k: int = K, m: int = SEED, digest_only: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (text) and paths for each document.

    Null and empty texts have no words. Documents shorter than an edge lose nothing. Rows alike in id and
    text count as one document and get the same result. Unlike texts of one id are documents of their own,
    in the order of their checksums; ``source_doc`` is the id that they share. Rows without an id lose
    nothing and are nobody's source. An empty table gives no rows.
    """
    stage = Stage(spark, "substring")
    docs = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    known, nameless = docs.filter("doc_id is not null"), docs.filter("doc_id is null")
    if known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        out = _dedup(spark, stage, known.select(F.col("doc_id").alias("doc"), "text"), k, m, digest_only).withColumnRenamed("doc", "doc_id")
    else:
        keys = stage.write(_row_keys(known), "keys")
        keyed = known.withColumn("sum", _checksum()).join(keys, ["doc_id", "sum"])
        once = keyed.filter("n = 1").select(F.col("key").alias("doc"), "text").unionByName(keyed.filter("n > 1").groupBy(F.col("key").alias("doc")).agg(F.first("text").alias("text")))
        out = _with_ids(stage, _dedup(spark, stage, once, k, m, digest_only), keys)
    rest = nameless.select(F.col("doc_id").alias("doc"), "text", F.lit(None).cast("array<struct<start:long,count:long,source_doc:long,source_start:long>>").alias("spans"))
    rest = rest.mapInArrow(_cut_task(k, digest_only), KEPT).withColumnRenamed("doc", "doc_id")
    return out.unionByName(rest)


def _checksum() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _row_keys(known: DataFrame) -> DataFrame:
    """doc_id, sum, n (rows), key for each id and text: keys follow the order of (doc_id, sum)."""
    rows = known.select("doc_id", _checksum().alias("sum")).groupBy("doc_id", "sum").agg(F.count("*").alias("n"))
    return rows.orderBy("doc_id", "sum").withColumn("key", F.monotonically_increasing_id())


def _with_ids(stage: Stage, out: DataFrame, keys: DataFrame) -> DataFrame:
    """The result with ids in place of keys, in the paths too, and once for each of the rows that a key stands for."""
    out = stage.write(out.withColumnRenamed("doc", "key"), "out")
    named = out.join(keys.select("key", F.col("doc_id").alias("id"), "n"), "key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    ids = keys.select(F.col("key").alias("source"), F.col("doc_id").alias("source_id"))
    steps = out.select(F.col("key").alias("of"), F.explode("paths").alias("p")).join(ids, F.col("p.source_doc") == F.col("source"))
    path = F.struct("p.start", "p.words", F.col("source_id").alias("source_doc"), "p.source_start")
    steps = steps.groupBy("of").agg(F.array_sort(F.collect_list(path)).alias("known_paths"))  # a document's own paths
    named = named.join(steps, F.col("key") == F.col("of"), "left")
    return named.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept", F.coalesce("known_paths", "paths").alias("paths"))


def graph(spark: SparkSession, stage: Stage, texts: DataFrame, k: int, m: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Of texts with unique keys: the runs of later places (RUN), cut at branching nodes, and the paths of the graph.

    Further places in a chunk travel with the seeds and edges that are dealt, each in a group of its own.
    """
    further = F.col("known") == 2
    seeds = texts.mapInArrow(_seed_task(k, m), SEEDS).withColumn("group", F.when(further, F.xxhash64("doc", "at")).otherwise(F.col("h"))).drop("h")
    of = W.partitionBy("group")
    dealt = seeds.repartition(n, "group").withColumns({"places": F.count("*").over(of), "again": F.max("known").over(of)})
    places = dealt.filter("places > 1 or again > 0").repartition(n, "doc").groupBy("doc").agg(F.collect_list("at").alias("places"))  # a document's own seeds
    places = stage.bucketed(places, "places", n, "doc")
    stage.free()

    edges = texts.join(places, "doc").select("doc", "text", "places").mapInArrow(_edge_task(k, m), EDGES)
    # Of an edge: hash, document, check and start. Of a run of further places: document, start, source document, source start, edges.
    same = W.partitionBy("kind", "a", "group").orderBy("b", "c")
    edges = edges.withColumn("group", F.when(F.col("kind") == 0, F.shiftright("c", 32)).otherwise(F.col("b"))).repartition(n, "kind", "a", "group")
    start = F.col("c").bitwiseAND(F.lit(0xFFFFFFFF))
    edges = edges.withColumn("first", F.first(F.struct("b", "c")).over(same)).filter("kind = 1 or first.b != b or first.c != c")
    lead = F.struct(F.col("b").alias("doc"), start.alias("start"), F.col("first.b").alias("source_doc"), F.col("first.c").bitwiseAND(F.lit(0xFFFFFFFF)).alias("source_start"), F.lit(1).cast("long").alias("count"))
    run = F.struct(*[F.col(x).alias(c.split()[0]) for x, c in zip("abcde", RUN.split(", "), strict=True)])
    edges = stage.write(edges.select("kind", F.when(F.col("kind") == 0, lead).otherwise(run).alias("run")).select("kind", "run.*"), "edges")
    stage.free()

    later = edges.filter("kind = 0").drop("kind").repartition(n, "doc").sortWithinPartitions("doc", "start")
    later = stage.write(later.mapInArrow(_glue, RUN), "later")
    # Places of a chunk refer to the first one of the chunk, which refers to the source.
    lead = later.select("doc", "start", "count", F.col("source_doc").alias("to_doc"), F.col("source_start").alias("to_start"))
    found = stage.write(later.unionByName(translate(stage, edges.filter("kind = 1").drop("kind"), lead, n, "near")), "found")
    for name in ("edges", "later"):
        stage.drop(name)

    sources = stage.write(stretches(found), "sources")
    joints = stage.write(junctions(found, sources), "joints")
    parts = stage.write(pieces(sources, joints), "pieces")
    compact = stage.write(paths(stage, parts, joints), "compact")
    same_place = compact.select("doc", "start", "count", F.col("doc").alias("to_doc"), F.col("start").alias("to_start"))
    return stage.write(translate(stage, found, same_place, n, "found"), "spans"), compact


def _dedup(spark: SparkSession, stage: Stage, docs: DataFrame, k: int, m: int, digest_only: bool) -> DataFrame:
    """``dedup`` of (doc, text) with unique keys."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(width(spark), -(-size // BUCKET))
    texts = stage.bucketed(docs, "docs", n, "doc")
    stage.free()
    found, _ = graph(spark, stage, texts, k, m, n)
    good = stage.write(verified(stage, texts, found, k, n), "verified")
    entry = ["start", "count"] if digest_only else ["start", "count", "source_doc", "source_start"]
    spans = good.repartition(n, "doc").groupBy("doc").agg(F.collect_list(F.struct(*entry)).alias("spans"))  # a document's own spans
    return texts.join(spans, "doc", "left").select("doc", "text", "spans").mapInArrow(_cut_task(k, digest_only), KEPT)


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return dedup(spark, docs, digest_only=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
e AS (
  SELECT doc_id, i AS start, array_to_string(list_slice(words, i, i + 19), ' ') AS edge
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS i FROM w WHERE len(words) >= 20) x),
r AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY edge ORDER BY doc_id, start) AS place FROM e) y WHERE place > 1),
c AS (SELECT DISTINCT doc_id, start + o AS i FROM r CROSS JOIN (SELECT unnest(generate_series(0, 19)) AS o) z),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(len(g.gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w.words, lambda x, i: g.gone IS NULL OR NOT list_contains(g.gone, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""
