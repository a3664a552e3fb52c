"""Mixture-controlled packing by deficit round-robin over source queues.

Each task holds a queue of tokens for each source. A window of 2048 tokens grants every source its
target share as credit; in ring order a source with enough credit sends tokens, documents being cut
freely, and what it is still owed is carried to the next window. Targets are given weights or, by
default, the shares of the sources in the bytes of the whole table; every task works towards the same.
A source that runs out leaves its part to the others, and is owed it. A task's last, unfilled window is
carried on: the tails of many tasks form new queues, with the credits that are still owed, and are
packed the same way.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprolens.llm.common import U64, Stage, as_bytes, batches, mix, plain, powers, trim, width

WINDOW = 2048
QUANTUM = 128  # least credit with which a source sends
END = 1  # id after each document
BATCH = 1 << 20  # bytes of text that a task encodes at once
HELD = 1 << 23  # most tokens that a task holds before it packs them, about; bounds memory, targets don't depend on it
TAILS = 64  # tasks whose tails are packed together
_ENCODERS: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary lies on this machine; ids equal those of the tokenizers file of the same name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(name: str) -> dict[str, int]:
    """Added tokens, with their ids, of the tokenizers file that a vocabulary of ranks belongs to; none if there is no such file."""
    try:
        path = tokenizer_path(name.rsplit(".", 1)[0] + ".json")
    except (KeyError, FileNotFoundError):
        return {}
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    at = text.find("[", text.find('"added_tokens"'))  # only this list is parsed: the vocabulary would take much memory
    return {t["content"]: t["id"] for t in json.JSONDecoder().raw_decode(text, at)[0]}


class Encoder:
    """Ids of texts as little-endian 32-bit integers, each text followed by the end mark.

    A single space between two characters that aren't white space always starts a token. Texts are
    cut there; most strings between repeat within a batch, and each is encoded once. Strings are told
    apart by a 64-bit hash, checked by a second one. Texts that hold an added token of the tokenizers
    file are encoded whole, with that token's id.
    """

    def __init__(self, name: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(tokenizer_path(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.added = added_tokens(name)
        self.raw = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        self.marks = re.compile(b"|".join(re.escape(x.encode()) for x in self.added)) if self.added else None
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.raw.encode_ordinary(text), dtype="<u4")

    def all_ids(self, text: str) -> np.ndarray:
        return np.array(self.raw.encode(text, allowed_special=set(self.added), disallowed_special=()), dtype="<u4")

    def encode(self, raw: list[bytes]) -> list[bytes]:
        begins, lengths, hashes, checks = spans(raw)  # of the strings, in the batch's bytes
        text_of = np.concatenate([[0], np.cumsum(np.fromiter((x.count(b" ") + 1 for x in raw), dtype=np.int64, count=len(raw)))])
        first = text_of[:-1]
        rest = np.ones(len(begins), dtype=bool)
        rest[first] = False
        _, where, back = np.unique(hashes[rest], return_index=True, return_inverse=True)
        where = np.flatnonzero(rest)[where]
        joined = b" ".join(raw)
        # White space next to a space may join it: texts with such strings are encoded whole, as are all if hashes collide.
        odd = spaced(np.frombuffer(joined, dtype=np.uint8), begins[where], lengths[where])
        whole = np.fromiter((self.marks is not None and self.marks.search(x) is not None for x in raw), dtype=bool, count=len(raw))
        owner = np.repeat(np.arange(len(raw)), np.diff(text_of))
        whole[owner[rest][odd[back]]] = True
        whole |= not (checks[where][back] == checks[rest]).all()
        fine = where[~odd]
        strings = b" ".join([joined[a:b] for a, b in zip(begins[fine].tolist(), (begins + lengths)[fine].tolist(), strict=True)])
        tokens = self.ids(" " + strings.decode() if len(fine) else "")
        ends = np.cumsum(self.sizes[tokens])
        bounds = np.cumsum(np.where(odd, 0, lengths[where] + 1))
        stops = np.searchsorted(ends, bounds, side="left") + 1
        stops[bounds == 0] = 0
        starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
        # Then the first strings of texts, which no space precedes, and the mark.
        heads = []
        for t, (i, n) in enumerate(zip(first.tolist(), lengths[first].tolist(), strict=True)):
            head = raw[t][:n]
            last = head.decode()[-1:] if head else ""
            whole[t] |= n < len(raw[t]) and (not head or last.isspace())
            heads.append(self.all_ids(raw[t].decode()) if whole[t] else self.ids(head.decode()))
        table = np.concatenate([tokens, *heads, np.array([END], dtype="<u4")])
        head_stops = len(tokens) + np.cumsum(np.fromiter(map(len, heads), dtype=np.int64, count=len(heads)))
        starts = np.concatenate([starts, [len(tokens)], head_stops]).astype(np.int64)
        stops = np.concatenate([stops, head_stops, [len(table)]]).astype(np.int64)
        # What each text is made of: its first string, the others (unless it is encoded whole), the mark.
        row = np.zeros(len(begins), dtype=np.int64)
        row[first] = len(where) + np.arange(len(raw))
        row[rest] = back
        keep = ~whole[owner]
        keep[first] = True
        counts = np.add.reduceat(keep, first) if len(raw) else keep[:0]
        at = np.cumsum(counts + 1) - 1
        order = np.full(int(counts.sum()) + len(raw), len(starts) - 1, dtype=np.int64)
        order[np.delete(np.arange(len(order)), at)] = row[keep]
        sizes = stops[order] - starts[order]
        total = np.concatenate([[0], np.cumsum(sizes)])
        out = table[np.repeat(starts[order] - total[:-1], sizes) + np.arange(total[-1])].tobytes()
        edge = (4 * np.concatenate([[0], total[at + 1]])).tolist()
        return [out[a:b] for a, b in zip(edge, edge[1:], strict=False)]


def spaced(buffer: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the strings are empty, or start or end with white space (of any script)."""
    if not len(begins):
        return np.zeros(0, dtype=bool)
    last = begins + lengths - 1
    first = buffer[np.minimum(begins, len(buffer) - 1)]
    out = (lengths == 0) | _BLANK[first] | _BLANK[buffer[last]]
    maybe = ~out & (_LEAD[first] | _LEAD[buffer[np.maximum(last - 1, 0)]] | _LEAD[buffer[np.maximum(last - 2, 0)]])
    for i in np.flatnonzero(maybe):
        text = buffer[begins[i] : last[i] + 1].tobytes().decode()
        out[i] = text[0].isspace() or text[-1].isspace()
    return out


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_LEAD = np.zeros(256, dtype=bool)  # first bytes of the UTF-8 forms of other white space
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def spans(raw: list[bytes], limit: int = 1 << 18) -> tuple[np.ndarray, ...]:
    """Begin, length and two hashes of the strings between spaces, in the texts joined by spaces."""
    parts, base, group, held = [], 0, [], 0

    def flush() -> None:
        nonlocal base, group, held
        buffer = np.frombuffer(b" ".join(group) + b" ", dtype=np.uint8)
        end = np.flatnonzero(buffer == 0x20)
        begin = np.concatenate([[0], end[:-1] + 1])
        codes, found = buffer.astype(U64) + U64(1), []
        for power, inverse in (powers(len(buffer), seed) for seed in (0, 1)):
            sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(codes * power[: len(buffer)])])
            found.append(mix((sums[end] - sums[begin]) * inverse[begin] ^ ((end - begin).astype(U64) << U64(48))))
        parts.append((begin + base, end - begin, *found))
        base, group, held = base + len(buffer), [], 0

    for x in raw:
        group.append(x)
        held += len(x) + 1
        if held > limit:
            flush()
    if group:
        flush()
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


@dataclass
class Queue:
    """Tokens of a source: (doc_id, start, ids, tokens in the document), the credit it is owed, its target share (any scale)."""

    left: int = 0
    credit: float = 0.0
    share: float = 0.0
    items: deque = field(default_factory=deque)

    def put(self, doc_id, start: int, ids: bytes, tokens: int) -> None:
        self.items.append((doc_id, start, ids, tokens))
        self.left += len(ids) // 4

    def take(self, n: int) -> Iterator[tuple]:
        """Pieces of n tokens in all: doc_id, start, length, checksum, tokens in the document, ids."""
        self.left -= n
        self.credit -= n
        while n:
            doc_id, start, ids, tokens = self.items.popleft()
            m = min(n, len(ids) // 4)
            if 4 * m < len(ids):
                self.items.appendleft((doc_id, start + m, memoryview(ids)[4 * m :], tokens))
            cut = memoryview(ids)[: 4 * m]
            yield doc_id, start, m, zlib.crc32(cut), tokens, cut
            n -= m


def drain(queues: dict, last: bool, window: int = WINDOW, quantum: int = QUANTUM, keep: int = 0) -> Iterator[list[tuple]]:
    """Windows as lists of pieces, until ``keep`` tokens or less than a window are left; ``last``: until nothing is left."""
    names = sorted(queues, key=lambda s: (s is None, s))
    held = [queues[s] for s in names]
    total = sum(q.left for q in held)
    share = np.array([max(q.share, 0.0) for q in held], dtype=np.float64)
    share = share / share.sum() if share.sum() > 0 else np.full(len(held), 1 / max(1, len(held)))
    credit, left = np.array([q.credit for q in held]), np.array([q.left for q in held])
    turn, count = 0, len(held)
    while (total >= window and total > keep) or (last and total):
        need = size = min(window, total)
        credit += share * size
        out: list[tuple] = []

        def send(i: int, n: int) -> int:
            n = max(0, min(n, int(left[i]), need))
            if n:
                out.extend(held[i].take(n))
                credit[i] -= n
                left[i] -= n
            return n

        ready = np.flatnonzero((credit >= min(quantum, size)) & (left > 0))
        for i in np.concatenate([ready[ready >= turn], ready[ready < turn]]):
            need -= send(i, int(credit[i]))
            if not need:
                turn = int(i)
                break
        if need:  # what is owed in parts below the quantum, and the parts of queues that ran out
            for i in np.argsort(-np.where(left > 0, credit, -np.inf), kind="stable"):
                need -= send(i, max(quantum, int(credit[i])))
                if not need:
                    turn = (int(i) + 1) % count
                    break
        while need:  # only queues that owe are left: each gives a quantum in turn, the one that owes least first
            for i in np.argsort(-np.where(left > 0, credit, -np.inf), kind="stable"):
                need -= send(i, quantum)
                if not need:
                    break
        total -= size
        yield out
    for q, c in zip(held, credit, strict=True):
        q.credit = float(c)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, credit double, share double, ids binary"
_SCHEMA = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}[x.split()[1]]) for x in PIECES.split(", ")])


def _rows(windows: Iterable[list[tuple]], first: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    sequence = first
    for pieces in windows:
        offset = 0
        for doc_id, start, n, crc, tokens, _ in pieces:
            rows.append((doc_id, start, n, crc, tokens, sequence, offset, None, None, None, None))
            offset += n
        sequence += 1
        if len(rows) > 20_000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _pack_task(name: str):
    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, queues, held = encoder(name), {}, 0
        task = TaskContext.get().partitionId()
        sequence = task << 32

        def windows(last: bool, keep: int = 0) -> Iterator[list[tuple]]:
            nonlocal sequence
            for w in drain(queues, last, keep=keep):
                sequence += 1
                yield w

        for b in batches(frames, limit=BATCH):
            for doc_id, source, share, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), enc.encode(as_bytes(b.column(2))), strict=True):
                queues.setdefault(source, Queue(share=share or 0.0)).put(doc_id, 0, ids, len(ids) // 4)
                held += len(ids) // 4
            if held > HELD:  # half stays, so that sources that are short now can catch up
                yield from _rows(windows(False, HELD // 2), sequence)
                held = sum(q.left for q in queues.values())
        yield from _rows(windows(False), sequence)
        rows = []  # less than a window: carried on with the credits
        for source, q in queues.items():
            credit = q.credit
            for doc_id, start, n, crc, tokens, cut in q.take(q.left):
                rows.append((doc_id, start, n, crc, tokens, task, len(rows), source, credit, q.share, bytes(cut)))
                credit = 0.0
        if rows:
            yield _batch(rows)
        queues.clear()
        trim()

    return run


def _pack_tails(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    queues: dict = {}
    frame = frame.sort_values(["sequence_id", "offset"])
    for r in frame.itertuples():
        q = queues.setdefault(r.source, Queue(share=r.share))
        q.put(r.doc_id, r.start, r.ids, r.doc_tokens)
        q.credit += r.credit
    out = [(d, s, n, crc, t, ((1 << 30) + int(key[0]) << 32) + i, 0, None, None, None, None) for i, w in enumerate(drain(queues, True)) for d, s, n, crc, t, _ in w]
    frame = pd.DataFrame(out, columns=_SCHEMA.names)
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
    return frame


def shares(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """_source, _share: the target of each source. By default its part of all bytes (each document's end mark counts as one)."""
    if weights is not None:
        spark = docs.sparkSession
        total = sum(weights.values())
        if total <= 0 or min(weights.values()) < 0:
            raise ValueError("weights are not negative, and some are positive")
        return spark.createDataFrame([(s, float(w) / total) for s, w in weights.items()], "_source string, _share double")
    sizes = docs.groupBy(F.col("source").alias("_source")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("_share"))
    return sizes.select("_source", F.col("_share").cast("double"))


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", weights: dict | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece.

    ``weights`` gives the target proportions of the sources in every window (the null source by the key
    None); sources without one have target 0 and fill what the others can't. By default targets are the
    sources' parts of the whole table. All tokens are packed in any case: once a source has run out, its
    part goes to the others.
    Null and empty texts have one token, the end mark. Null sources form a queue of their own. Rows
    that repeat a doc_id are packed as documents of their own. An empty table gives no rows. Only the
    last window of each group of tails is short, so padding is at most a window for each ``TAILS`` tasks.
    """
    stage = Stage(spark, "pack")
    given = plain(docs, "doc_id", "source", "text")
    targets = stage.write(shares(given, weights), "targets")
    given = given.join(targets, given["source"].eqNullSafe(targets["_source"]), "left").select("doc_id", "source", "text", "_share")
    # Dealt by id, so that every task gets the corpus's mix of sources; sorted, so that a task that runs again packs alike.
    dealt = given.repartition(width(spark), F.xxhash64("doc_id")).sortWithinPartitions("doc_id")
    pieces = stage.write(dealt.mapInArrow(_pack_task(vocabulary), PIECES), "pieces")
    tails = pieces.filter("ids is not null").withColumn("group", F.floor(F.col("sequence_id") / TAILS)).groupBy("group").applyInPandas(_pack_tails, PIECES)
    return pieces.filter("ids is null").unionByName(tails).drop("source", "credit", "share", "ids")
