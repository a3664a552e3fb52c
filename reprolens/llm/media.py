"""Media columns: ISO media containers written, walked and described without decoding payloads.

``encode`` stores bytes as 8-bit samples of one audio track in an ISO base media file (nested boxes,
sample tables, chunk offsets). ``walk`` and ``describe`` read any such file: nested boxes, sample
tables, codec, duration and the byte ranges of sync samples. Null bytes count as empty ones.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprolens.llm.common import as_bytes, batches, plain
from reprolens.sources.staging import small_batches

BLOCK = 64  # payloads are padded to a positive multiple of this
RATE = 8000  # samples a second
SAMPLE = 1024  # most bytes in one sample of the track
CHUNK = 16  # samples in a chunk
SYNC = 8  # every so many samples one is a sync sample
#: Boxes that hold boxes, with the bytes before the first child.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)
    return struct.pack(">I4s", size, kind) + b"".join(parts)


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    return data + bytes(max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


def encode(payload: bytes) -> bytes:
    """An ISO media file whose only track holds the payload as 8-bit mono samples."""
    full, rest = divmod(len(payload), SAMPLE)
    sizes = [SAMPLE] * full + [rest] * bool(rest)
    n, chunks = len(sizes), -(-len(sizes) // CHUNK)
    last = n - (chunks - 1) * CHUNK if chunks else 0
    times = [(full, SAMPLE)] * bool(full) + [(1, rest)] * bool(rest)
    groups = [(1, CHUNK, 1)] if chunks and last == CHUNK else ([(1, CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)] * bool(chunks))
    sync = range(1, n + 1, SYNC)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")

    def moov(first: int) -> bytes:
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">I", len(times)), *(struct.pack(">II", *x) for x in times)),
            _full(b"stss", struct.pack(">I", len(sync)), np.asarray(sync, dtype=">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(groups)), *(struct.pack(">III", *x) for x in groups)),
            _full(b"stsz", struct.pack(">II", 0, n), np.asarray(sizes, dtype=">u4").tobytes()),
            _full(b"co64", struct.pack(">I", chunks), (first + np.arange(chunks, dtype=">u8") * (SAMPLE * CHUNK)).astype(">u8").tobytes()),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, len(payload), 0x55C4, 0), version=1),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _box(b"trak", _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), MATRIX, bytes(8), version=1, flags=7), media)
        return _box(b"moov", _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, len(payload), 0x10000, 256), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1), track)

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    at = len(ftyp) + len(moov(0)) + head  # co64 entries have a fixed width, so the length doesn't depend on them
    return ftyp + moov(at) + _box(b"mdat", payload)


def walk(data: bytes, at: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, body start, body end) of each box, outer ones first; stops at a box that overruns its parent."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        here = f"{path}/{kind.decode('latin-1')}"
        yield here, at + head, at + size
        if kind in CONTAINERS:
            yield from walk(data, at + head + CONTAINERS[kind], at + size, here)
        at += size


def _table(data: bytes, a: int, b: int, kind: str, columns: int) -> np.ndarray:
    """The entries of a counted table that lie within its box, whatever the count says."""
    (n,) = struct.unpack_from(">I", data, a + 4)
    n = min(n, (b - a - 8) // (np.dtype(kind).itemsize * columns))
    return np.frombuffer(data, kind, n * columns, a + 8).astype(np.int64).reshape(n, columns)


def tracks(data: bytes) -> list[dict]:
    """The tracks with id, codec, time scale, duration and decoded sample tables; payloads aren't touched.

    Samples of movie fragments are decoded from their runs: ``runs`` holds (offset, size, ticks, sync) of each,
    and their ticks are added to the duration where the header has none.
    """
    found: list[dict] = []
    extends: dict[int, tuple] = {}
    base, here = 0, None
    for path, a, b in walk(data):
        name = path.rsplit("/", 1)[1]
        if name == "trak":
            found.append({"id": len(found) + 1, "runs": []})
        elif name == "trex" and b - a >= 24:
            extends[struct.unpack_from(">I", data, a + 4)[0]] = struct.unpack_from(">III", data, a + 12)
        elif name == "moof":
            base = a - 8 if data[a - 4 : a] == b"moof" else a - 16  # where the fragment's box begins
        elif name == "traf":
            here = None
        elif name == "tfhd" and b - a >= 8:
            here = _fragment(data, a, base, extends)
        elif name == "trun" and here is not None and b - a >= 8:
            for t in found:
                if t["id"] == here["id"]:
                    t["runs"] += _run(data, a, b, here)
        if not found or path.startswith("/moof"):
            continue
        t = found[-1]
        if name == "tkhd" and b - a >= 24:
            t["id"] = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
        elif name == "mdhd" and b - a >= (32 if data[a] == 1 else 20):
            wide = data[a] == 1
            t["scale"], t["ticks"] = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
        elif name == "hdlr" and b - a >= 12:
            t["kind"] = data[a + 8 : a + 12].decode("latin-1")
        elif name == "stsd" and b - a >= 16:
            t["codec"] = data[a + 12 : a + 16].decode("latin-1")
        elif name in ("stts", "stss", "stsc", "co64", "stco") and b - a >= 8:
            t["stco" if name == "co64" else name] = _table(data, a, b, ">u8" if name == "co64" else ">u4", {"stts": 2, "stsc": 3}.get(name, 1))
        elif name == "stsz" and b - a >= 12:
            fixed, n = struct.unpack_from(">II", data, a + 4)
            t["stsz"] = np.full(n, fixed, dtype=np.int64) if fixed else np.frombuffer(data, ">u4", min(n, (b - a - 12) // 4), a + 12).astype(np.int64)
    for t in found:
        t["ticks"] = t.get("ticks") or sum(r[2] for r in t["runs"])
    return found


def _fragment(data: bytes, a: int, base: int, extends: dict[int, tuple]) -> dict:
    """Track id, data offset and defaults (ticks, size, flags) of a track fragment."""
    flags, track = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF, struct.unpack_from(">I", data, a + 4)[0]
    at = a + 8
    out = {"id": track, "at": base, "defaults": list(extends.get(track, (0, 0, 0)))}
    if flags & 0x1:
        (out["at"],) = struct.unpack_from(">Q", data, at)
        at += 8
    at += 4 * bool(flags & 0x2)
    for i, bit in enumerate((0x8, 0x10, 0x20)):
        if flags & bit:
            (out["defaults"][i],) = struct.unpack_from(">I", data, at)
            at += 4
    out["next"] = out["at"]
    return out


def _run(data: bytes, a: int, b: int, fragment: dict) -> list[tuple[int, int, int, bool]]:
    """(offset, size, ticks, sync) of the samples of a run; a sample is a sync sample if its flags don't say otherwise."""
    flags, n = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF, struct.unpack_from(">I", data, a + 4)[0]
    at, place = a + 8, fragment["next"]
    if flags & 0x1:
        place = fragment["at"] + struct.unpack_from(">i", data, at)[0]
        at += 4
    first = None
    if flags & 0x4:
        (first,) = struct.unpack_from(">I", data, at)
        at += 4
    step = 4 * sum(bool(flags & bit) for bit in (0x100, 0x200, 0x400, 0x800))
    out = []
    for i in range(min(n, (b - at) // step) if step else n):
        values = list(fragment["defaults"])
        for k, bit in enumerate((0x100, 0x200, 0x400)):
            if flags & bit:
                (values[k],) = struct.unpack_from(">I", data, at)
                at += 4
        at += 4 * bool(flags & 0x800)
        ticks, size, marks = values
        if i == 0 and first is not None:
            marks = first
        if place + size > len(data):
            break
        out.append((place, size, ticks, not marks & 0x10000))
        place += size
    fragment["next"] = place
    return out


def ranges(track: dict) -> np.ndarray:
    """Byte offset and size of each sample, from the chunk table, then from the runs of fragments."""
    sizes, chunks, groups = track.get("stsz", np.zeros(0, np.int64)), track.get("stco", np.zeros((0, 1), np.int64))[:, 0], track.get("stsc", np.zeros((0, 3), np.int64))
    runs = np.array([r[:2] for r in track["runs"]], dtype=np.int64).reshape(-1, 2)
    if not len(sizes) or not len(chunks) or not len(groups):
        return runs
    counts = np.repeat(groups[:, 1], np.maximum(0, np.diff(np.append(groups[:, 0], len(chunks) + 1))))[: len(chunks)]
    chunk = np.repeat(np.arange(len(counts)), counts)[: len(sizes)]
    sizes = sizes[: len(chunk)]
    before = np.concatenate([[0], np.cumsum(sizes)])
    first = np.concatenate([[0], np.cumsum(counts)])[chunk]
    return np.concatenate([np.stack([chunks[chunk] + before[: len(sizes)] - before[first], sizes], axis=1), runs])


def keyframes(track: dict) -> np.ndarray:
    """Byte ranges of the sync samples; without a table of them every sample of the chunk table is one."""
    every = ranges(track)
    n = len(every) - len(track["runs"])
    sync = np.zeros(len(every), dtype=bool)
    if "stss" in track:
        at = track["stss"][:, 0] - 1
        sync[at[(at >= 0) & (at < n)]] = True
    else:
        sync[:n] = True
    sync[n:] = [r[3] for r in track["runs"]]
    return every[sync]


def read_samples(data: bytes) -> bytes:
    """The stored bytes of the first track, found through its sample tables; neighbouring ranges are read at once."""
    found = tracks(data)
    r = ranges(found[0]) if found else np.zeros((0, 2), np.int64)
    if not len(r):
        return b""
    cut = np.flatnonzero(r[1:, 0] != r[:-1, 0] + r[:-1, 1]) + 1
    begin, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(r)]])
    return b"".join(data[r[i, 0] : r[j - 1, 0] + r[j - 1, 1]] for i, j in zip(begin, stop, strict=True))


def _text(t: dict) -> str:
    r, key = ranges(t), keyframes(t)
    mark = hashlib.sha256(key.astype("<i8").tobytes()).hexdigest()[:16]
    ends = ",".join(f"{a}+{n}" for a, n in (key[[0, -1]] if len(key) else key))
    return f"codec={t.get('codec', '').strip()};kind={t.get('kind', '')};duration={_seconds(t):.6f};samples={len(r)};keyframes={len(key)};ranges={ends};digest={mark}"


def _seconds(t: dict) -> float:
    return t["ticks"] / t["scale"] if t.get("scale") else 0.0


def describe(data: bytes) -> str:
    """Of each track, joined by a bar: codec, duration in seconds, samples, and the byte ranges of sync samples as a short digest with the first and last one."""
    return "|".join(map(_text, tracks(data)))


ENCODED = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration double, keyframes array<struct<offset:long,size:long>>"


def store(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A media column: one container for each row's UTF-8 text, padded with zero bytes; null and empty text give 64 zero bytes."""

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            raw = as_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array([encode(pad(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, ENCODED)


def features(media: DataFrame) -> DataFrame:
    """Reads the stored bytes back through the sample tables and describes each container. Equal media give equal values.

    codec, duration and keyframes are those of the first track, feature has all tracks. Null media count as
    empty; bytes without a track have no payload, an empty feature and null codec and duration.
    """

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, "media"):
            rows = []
            for doc, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = data or b""
                payload, found = read_samples(data), tracks(data)
                codec, seconds, key = (found[0].get("codec"), _seconds(found[0]), keyframes(found[0])) if found else (None, None, [])
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), "|".join(map(_text, found)), codec, seconds, [{"offset": int(a), "size": int(s)} for a, s in key]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))]
            names = [x.split(" ")[0] for x in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "keyframes")]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return media.mapInArrow(run, FEATURES)


def digest(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (repeated rows too): sizes, checksums of what was read back, features. An empty table gives an empty table."""
    out = features(store(plain(docs, "doc_id", "text")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
