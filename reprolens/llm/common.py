"""Helpers that the training-data operators share: staging, word hashing, documents."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprolens.sources.staging import Stage as Stage  # used by the operators from here

#: ASCII white space between words: \x20 and \x09-\x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def width(spark: SparkSession, least: int = 1) -> int:
    """Number of tasks for a Python stage that is dealt by hash."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: a bijection whose bits all depend on all input bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
KEPT = 1 << 20  # most powers of a seed that a process keeps, 16 bytes each: workers live on for other tasks and stages


def powers(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd multiplier and of its inverse modulo 2**64, grown on demand; more than KEPT are made for the caller only."""
    if seed not in _POWERS or len(_POWERS[seed][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        made = []
        for base in (_MULTIPLIERS[seed], pow(_MULTIPLIERS[seed], -1, 1 << 64)):
            p = np.ones(size, dtype=U64)
            done, step = 1, base
            while done < size:  # doubling: p[done:2*done] = p[:done] * base**done
                p[done : 2 * done] = p[:done] * U64(step)
                step = step * step & _MASK
                done *= 2
            made.append(p)
        if size > KEPT:
            return made[0], made[1]
        _POWERS[seed] = made[0], made[1]
    return _POWERS[seed]


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined by line feeds as an array; begin and end there of all words; offsets of each text's words."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[buffer], prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return buffer, starts, ends, np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths + 1)]))


def word_hashes(texts: list[bytes], lower: bool = False, limit: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, in order, and the offsets of each text's words.

    Words are maximal runs without ASCII white space. With ``lower``, A-Z count as a-z. Texts are
    hashed in groups of about ``limit`` bytes (at least one text), which bounds memory.
    """
    found, offsets, at, words = [], [np.zeros(1, dtype=np.int64)], 0, 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= limit):
            held += len(texts[end]) + 1
            end += 1
        h, o = _word_hashes(texts[at:end], lower)
        found.append(h)
        offsets.append(o[1:] + words)
        words += len(h)
        at = end
    return np.concatenate(found) if found else np.zeros(0, dtype=U64), np.concatenate(offsets)


def _word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    buffer, starts, ends, offsets = word_spans(texts)
    if not len(starts):
        return np.zeros(0, dtype=U64), offsets
    space = _SPACE[buffer]
    codes = _LOWER[buffer] if lower else buffer
    power, inverse = powers(len(buffer))
    terms = (codes.astype(U64) + U64(1)) * power[: len(buffer)]
    terms[space] = 0
    sums = np.add.reduceat(terms, starts) * inverse[starts]
    return mix(sums ^ ((ends - starts).astype(U64) << U64(48))), offsets


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k items, by doubling; len(h) - k + 1 of them (none if shorter)."""
    if len(h) < k:
        return np.zeros(0, dtype=U64)
    base = 0xD1342543DE82EF95
    out, have, part, size = None, 0, h, 1
    bits = k
    while True:  # out covers ``have`` items, part covers ``size``
        if bits & 1:
            if out is None:
                out, have = part, size
            else:
                n = len(h) - have - size + 1
                out = out[:n] * U64(pow(base, size, 1 << 64)) + part[have : have + n]
                have += size
        bits >>= 1
        if not bits:
            break
        n = len(h) - 2 * size + 1
        part = part[:n] * U64(pow(base, size, 1 << 64)) + part[size : size + n]
        size *= 2
    return mix(out)


def batches(frames: Iterable[pa.RecordBatch], text: str = "text", limit: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds at most about ``limit`` bytes of text (one row at least)."""
    for batch in frames:
        n = batch.num_rows
        if n == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < n:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def trim() -> None:
    """Gives memory that a task has freed back to the system: its process lives on for other tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only there with glibc
        ctypes.CDLL(None).malloc_trim(0)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def plain(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns only: extra columns, whatever their names, never reach an operator's joins."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])
