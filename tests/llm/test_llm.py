"""Training-data operators against brute force, round trips and odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reprolens.llm import common, embed_dedup, jaccard, media, mixing, packing, pii, quality, quotes, resharding, substring_dedup
from reprolens.llm.components import connected

ODD = ["", "   ", " a\tb\x0bc ", "É é 　 x", "one", "a b c d e", "日本語 テキスト 🎉", "x" * 50_000, "w " * 3000, "a\x1cb \x85 c", "<|endoftext|> a", None]


def docs(spark, texts, sources=("s", "t", None)):
    rows = [(i, t, "en", sources[i % len(sources)], len(t or ""), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")


def empty(spark):
    return docs(spark, ["x"]).limit(0)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def prose(seed=0, n=60, vocabulary=400):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(vocabulary)]
    out = [" ".join(r.choice(v) for _ in range(r.randint(0, 120))) for _ in range(n)]
    passage = " ".join(r.choice(v) for _ in range(55))
    for i in range(0, n, 5):
        out[i] += " " + passage + " " + " ".join(r.choice(v) for _ in range(r.randint(0, 30)))
    out += [out[1], out[1], out[2].upper(), out[3] + " tail", passage, passage + " " + passage]
    return out + ODD


@given(st.lists(st.text(max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_word_hashes_follow_words(texts):
    h, at = common.word_hashes([t.encode() for t in texts], limit=16)
    flat = [w for t in texts for w in words_of(t)]
    assert np.diff(at).tolist() == [len(words_of(t)) for t in texts] and len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


@pytest.mark.parametrize("k", [1, 2, 3, 7, 20])
def test_rolling_equals_tuples(k):
    h = common.mix(np.random.default_rng(k).integers(0, 3, 200).astype(np.uint64))
    got = common.rolling(h, k)
    want = [tuple(h[i : i + k].tolist()) for i in range(len(h) - k + 1)]
    assert len(set(zip(want, got.tolist(), strict=True))) == len(set(want)) == len(set(got.tolist()))


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    parent = {i: i for i in range(300)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = dict(map(tuple, connected(common.Stage(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()))
    assert {i: got.get(i, i) for i in range(300)} == {i: root(i) for i in range(300)}
    assert connected(common.Stage(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1: personal data -------------------------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d.encode())) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


@given(st.text(alphabet="a.@-+1 2(9%0é_", max_size=40))
@settings(max_examples=500, deadline=None)
def test_base_spans_equal_patterns(text):
    raw = text.encode()
    got = [(len(raw[:a].decode()), len(raw[:b].decode()), k) for a, b, k in pii.base_spans(raw)]
    assert got == base(text)


@pytest.fixture(scope="module")
def trained():
    return pii.train(pii.labelled_rows())


def test_field_labels_held_out_rows(trained):
    right = total = 0
    sentences = {}
    for s, p, t, label in pii.labelled_rows(seed=99, sentences=140):
        sentences.setdefault(s, []).append((t, label))
    for words in sentences.values():
        text = " ".join(t for t, _ in words)
        at, marks = 0, {}
        for t, label in words:
            marks[at] = (at + len(t.encode()), label)
            at += len(t.encode()) + 1
        found = pii.field_spans([text.encode()], trained)[0]
        for a, (b, label) in marks.items():
            hit = next((k for x, y, k in found if x < b and a < y), "other")
            right += hit == label
            total += 1
    assert right / total > 0.97


def test_decoding_in_parts_equals_viterbi(trained):
    r = random.Random(5)
    pool = [t for _, _, t, _ in pii.labelled_rows(seed=3)]
    for _ in range(60):
        lines = [[r.choice(pool) for _ in range(r.randint(0, 25))] for _ in range(r.randint(1, 4))]
        want, base_at = [], 0
        for words in lines:
            if words:
                e = trained.emissions(words, np.arange(len(words)), np.zeros(len(words)))
                want += pii.viterbi(e[None], np.array([len(words)]), trained, np.array([False]), np.array([False]))[0].tolist()
        raw = "\n".join(" ".join(x) for x in lines).encode()
        del base_at
        covered = [any(a <= m.start() < b or (m.start() <= a < m.end()) for a, b, _ in pii.field_spans([raw], trained)[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        stripped = [w.strip(pii._STRIP) for x in lines for w in x]
        assert [bool(w) and bool(s) for w, s in zip(want, stripped, strict=True)] == [c and bool(s) for c, s in zip(covered, stripped, strict=True)]


def test_pii_digest_and_redaction(spark):
    texts = ["mail a.b@c.de or +1 (017) 555-7713", "é 97.51.17.173 x 4111 1111 1111 1111", 'token = "5d190bd7c06284de91015a36974748794293dd8a" x', *ODD]
    got = {r.doc_id: r for r in pii.digest(spark, docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        b = base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in b).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == j for x in b) for j in range(4)]
    assert got[2].spans == "secret:9:49"
    red = {r.doc_id: r for r in pii.redact(spark, docs(spark, texts)).collect()}
    assert red[0].text == "mail [EMAIL] or [PHONE]" and red[1].text == "é [IP] x [CARD]" and red[len(texts) - 1].text is None and red[3].text == ""
    assert red[0].n_chars == len(red[0].text) and pii.digest(spark, empty(spark)).count() == 0


# --- 2: media ---------------------------------------------------------------------------------------


@given(st.binary(max_size=5000))
@settings(max_examples=60, deadline=None)
def test_media_round_trip(data):
    payload = media.pad(data)
    stored = media.encode(payload)
    assert media.read_samples(stored) == payload and len(payload) % 64 == 0 and payload
    t = media.tracks(stored)[0]
    assert t["ticks"] == len(payload) and all(stored[a : a + n] in payload for a, n in media.ranges(t))


def _fragmented(size_flags: bool) -> tuple[bytes, bytes]:
    """A file whose samples lie in two movie fragments, of 3 and 2 samples; the first of each is a sync sample."""
    import struct

    box, full = media._box, media._full
    entry = box(b"avc1", bytes(8))
    table = box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", bytes(4)), full(b"stsc", bytes(4)), full(b"stsz", bytes(8)), full(b"stco", bytes(4)))
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 100, 0, 0, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), box(b"minf", table))
    trak = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0)), mdia)
    trex = full(b"trex", struct.pack(">IIIII", 7, 1, 25, 4, 0x10000))
    data = box(b"ftyp", b"isom", bytes(4)) + box(b"moov", trak, box(b"mvex", trex))
    payload = b""
    for sizes in ([5, 4, 4], [4, 4]):
        body = bytes(range(65, 65 + sum(sizes)))

        def moof(offset, sizes=sizes):
            flags = 0x1 | 0x4 | (0x200 if size_flags else 0)
            run = struct.pack(">IiI", len(sizes), offset, 0) + (struct.pack(f">{len(sizes)}I", *sizes) if size_flags else b"")
            return box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), full(b"trun", run, flags=flags)))

        if not size_flags:
            body = body[: 4 * len(sizes)]
        data += moof(len(moof(0)) + 8) + box(b"mdat", body)
        payload += body
    return data, payload


@pytest.mark.parametrize("size_flags", [True, False])
def test_fragments(size_flags):
    data, payload = _fragmented(size_flags)
    t = media.tracks(data)[0]
    assert media.read_samples(data) == payload and t["ticks"] == 125 and len(media.ranges(t)) == 5
    assert [n for _, n in media.keyframes(t).tolist()] == ([5, 4] if size_flags else [4, 4])
    assert media.describe(data).startswith("codec=avc1;kind=vide;duration=1.250000;samples=5;keyframes=2;")


def test_features_of_any_media(spark):
    stored = media.encode(media.pad(b"x" * 3000))
    a = stored.index(b"stss")
    no_sync = stored[:a] + b"free" + stored[a + 4 :]
    moov = stored.index(b"moov") - 4
    n = int.from_bytes(stored[moov : moov + 4], "big")
    trak = stored.index(b"trak") - 4
    m = int.from_bytes(stored[trak : trak + 4], "big")
    two = stored[:moov] + (n + m).to_bytes(4, "big") + stored[moov + 4 : moov + n] + stored[trak : trak + m] + stored[moov + n :]
    cut = [stored[:k] for k in range(0, 700, 13)]
    rows = [(i, 0, x) for i, x in enumerate([None, b"", b"no boxes", stored, no_sync, two, *cut])]
    got = {r.doc_id: r for r in media.features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert len(got) == len(rows) and got[0].feature == got[1].feature == got[2].feature == "" and got[0].codec is None and got[0].payload_bytes == 0
    assert len(got[4].keyframes) == 3 and len(got[3].keyframes) == 1 and got[5].feature.count("|") == 1


def test_media_digest(spark):
    texts = [*ODD, "same", "same"]
    got = {r.doc_id: r for r in media.digest(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[len(texts) - 1].media_sha256 == got[len(texts) - 2].media_sha256 and media.digest(empty(spark)).count() == 0


# --- 3: packing -------------------------------------------------------------------------------------


def test_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [x or "" for x in prose(3)] + ["<|endoftext|>", " <|endoftext|>x<|endoftext|><|endoftext|> y  z", "<|endoftext", "it's  we'll", "a \n b", " a", "a ", "1 2  3", "... !! ??", "a  b", "x  y z"]
    got = packing.encoder("byte_bpe_50k.tiktoken").encode([x.encode() for x in texts])
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_packing_covers_everything(spark):
    texts = prose(4, 80) * 3
    got = packing.pack(spark, docs(spark, texts)).toPandas()
    ids = packing.encoder("byte_bpe_50k.tiktoken").encode([(t or "").encode() for t in texts])
    for doc, g in got.sort_values("start").groupby("doc_id"):
        at, b = 0, ids[doc]
        for r in g.itertuples():
            assert r.start == at and r.doc_tokens == len(b) // 4 and r.ids_crc32 == zlib.crc32(b[4 * at : 4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(b)
    assert set(got.doc_id) == set(range(len(texts)))
    lengths = got.groupby("sequence_id").length.sum()
    assert lengths.max() <= 2048 and (lengths < 2048).sum() <= 1
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all()
    assert packing.pack(spark, empty(spark)).count() == 0


def test_windows_hold_the_mix():
    queues = {}
    for name, n in (("a", 60_000), ("b", 30_000), ("c", 10_000)):
        q = queues[name] = packing.Queue()
        q.share = n
        for i in range(0, n, 500):
            q.put((name, i), 0, np.zeros(500, "<u4").tobytes(), 500)
    carried = {"a": 0, "b": 0, "c": 0}
    for i, window in enumerate(packing.drain(queues, False), 1):
        assert sum(p[2] for p in window) == 2048
        for p in window:
            carried[p[0][0]] += p[2]
        for name, share in (("a", 0.6), ("b", 0.3), ("c", 0.1)):
            assert abs(carried[name] - share * 2048 * i) <= 3 * packing.QUANTUM


def test_windows_hold_given_weights_across_tasks(spark):
    texts = ["alpha beta gamma delta " * 40] * 600
    frame = docs(spark, texts, ["a", "b", None]).repartition(4)
    weights = {"a": 5.0, "b": 3.0, None: 2.0}
    got = packing.pack(spark, frame, weights=weights).toPandas()
    assert got.length.sum() == got.drop_duplicates("doc_id").doc_tokens.sum()
    got["source"] = [["a", "b", None][i % 3] or "-" for i in got.doc_id]
    per = got.groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0)
    tasks = per.groupby(per.index // 2**32)
    for _, windows in tasks:
        if len(windows) < 4:
            continue  # tails
        n = int((windows["a"] > 0).sum())  # until the source with the greatest weight runs out
        front = windows.sort_index().iloc[: max(1, n - 2)]
        for i in range(1, len(front) + 1):
            part = front.iloc[:i].sum()
            for s, w in weights.items():
                assert abs(part[s or "-"] - w / 10 * 2048 * i) <= 4 * packing.QUANTUM
    with pytest.raises(ValueError):
        packing.shares(frame, {"a": 0.0})


# --- 4: quality -------------------------------------------------------------------------------------


def test_scores_equal_plain_discriminants(spark):
    r = random.Random(8)
    vocabulary = ["the", "of", "menu", "Home", "x1", "word,", "text.", "ok!", "|"]
    texts = [" ".join(r.choice(vocabulary[: 4 + i % 6]) for _ in range(r.randint(1, 90))) for i in range(150)] + ODD
    labels = [(i, i % 3 % 2 if i % 10 else None) for i in range(150)] + [(3, 3 % 3 % 2), (None, 1), (7, 5)]
    frame = docs(spark, texts).unionByName(docs(spark, texts[:4]))  # ids 0 to 3 twice
    got = {x.doc_id: x.score for x in quality.scored(spark, frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = np.array([quality.statistics((t or "").encode()) for t in texts])
    known = [(i, i % 3 % 2) for i in range(150) if i % 10 and zlib.crc32(str(i).encode()) % 5]
    known += [(i, y) for i, y in known if i < 4]
    at, y = np.array([k for k, _ in known]), np.array([v for _, v in known])
    shift, scale = x[at].mean(axis=0), x[at].std(axis=0)
    scale[scale <= 1e-6] = 1
    z, d, density = (x - shift) / scale, x.shape[1], []
    covariance = {c: np.cov(z[at][y == c].T, bias=True) for c in (0, 1)}
    pooled = sum((y == c).mean() * covariance[c] for c in (0, 1))
    for c in (0, 1):
        n = (y == c).sum()
        a = max(quality.SHRINK, d / (n + d))
        s = (1 - a) * covariance[c] + a * (pooled + np.diag(np.diag(pooled))) / 2 + quality.RIDGE * np.eye(d)
        off = z - z[at][y == c].mean(axis=0)
        density.append(np.log((y == c).mean()) - np.linalg.slogdet(s)[1] / 2 - (off @ np.linalg.inv(s) * off).sum(axis=1) / 2)
    want = 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / np.sqrt(d), -60, 60)))
    assert [got[i] for i in range(len(texts))] == pytest.approx(want.tolist(), abs=1e-6)


def test_quality_separates(spark):
    r = random.Random(2)
    good = [" ".join(r.choice("the of and word text fine plain thing".split()) + r.choice(["", ".", ","]) for _ in range(r.randint(5, 80))) for _ in range(120)]
    bad = [" | ".join(r.choice("menu home login".split()) for _ in range(r.randint(5, 80))) for _ in range(40)]
    texts = [*good, *bad, *ODD]
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(160)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    got = quality.scored(spark, docs(spark, texts), labels).toPandas().set_index("doc_id")
    assert len(got) == len(texts) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out & (got.index < 160)]
    assert ((held.index < 120) == held.predicted).mean() > 0.95
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(20)] == got.sort_index().held_out[:20].tolist()
    none = quality.scored(spark, docs(spark, texts[:5]), labels.limit(0)).toPandas()
    assert (none.score == 0.5).all() and quality.scored(spark, empty(spark), labels).count() == 0
    kept = quality.keep_good(spark, docs(spark, texts), labels)
    assert kept.columns == docs(spark, ["x"]).columns and kept.filter("doc_id < 120").count() >= 118


# --- 5: embeddings ----------------------------------------------------------------------------------


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 40)
    r = np.random.default_rng(0)
    x = r.normal(size=(150, 16))
    for i in range(60):
        x[90 + i] = x[i] + r.normal(size=16) * r.choice([0.05, 0.25, 0.38])
    label = [int(v) for v in r.integers(0, 2, 150)]
    label[90:] = label[:60]
    rows = [(i, [float(c) for c in v], lab) for i, (v, lab) in enumerate(zip(x, label, strict=True))]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [1.0] * 15 + [None], 0), (204, rows[0][1], None), (205, rows[0][1], rows[0][2]), (206, [1e300] * 16, 0), (207, [], 1), (205, rows[0][1], rows[0][2])]
    got = {v.vec_id: v for v in embed_dedup.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("x", F.lit(1))).collect()}
    fine = {i: (np.array(v) / np.abs(v).max(), lab) for i, v, lab in rows if v and None not in v and np.isfinite(v).all() and np.any(v) and lab is not None}
    links = {(a, b) for a, (v, m) in fine.items() for b, (w, n) in fine.items() if a != b and m == n and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93}
    assert {i: g.n_links for i, g in got.items()} == {i: sum(a == i for a, _ in links) for i in got}
    for a, b in links:
        assert got[a].component_id == got[b].component_id <= min(a, b)
    assert all(g.kept == (g.component_id == i) for i, g in got.items()) and len(got) == len({r[0] for r in rows})


def test_recall_of_collisions():
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = r.normal(size=x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * off  # just above the threshold
    a, b = embed_dedup.linked(x, y)
    assert (a == b).sum() / 3000 > 0.995


# --- 6: substrings ----------------------------------------------------------------------------------


def test_substrings_equal_brute_force(spark):
    texts = prose(6, 50, 60)
    texts[7] = " ".join(["loop"] * 90)
    seen, gone = set(), {}
    lists = [words_of(t) for t in texts]
    for i, w in enumerate(lists):
        gone[i] = set()
        for s in range(len(w) - 19):
            edge = tuple(w[s : s + 20])
            if edge in seen:
                gone[i].update(range(s, s + 20))
            seen.add(edge)
    got = {r.doc_id: r for r in substring_dedup.dedup(spark, docs(spark, texts).repartition(3)).collect()}
    for i, w in enumerate(lists):
        kept = " ".join(x for k, x in enumerate(w) if k not in gone[i])
        assert (got[i].n_words, got[i].n_removed, got[i].kept, got[i].kept_sha256) == (len(w), len(gone[i]), kept, hashlib.sha256(kept.encode()).hexdigest())
        for p in got[i].paths:
            assert w[p.start : p.start + p.words] == lists[p.source_doc][p.source_start : p.source_start + p.words]
    assert substring_dedup.digest(spark, empty(spark)).count() == 0


# --- 7: mixing --------------------------------------------------------------------------------------


def test_mix_meets_targets(spark):
    r = random.Random(7)
    texts = [" ".join(["w"] * r.randint(0, 60)) for _ in range(900)] + ODD
    sources = ["b", "a", None, "é", "only"]
    frame = docs(spark, texts, sources)
    got = mixing.mix(spark, frame).toPandas()
    again = mixing.mix(spark, frame.repartition(5)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist() and len(got) == len(texts)
    size = {s: 0 for s in sources}
    for i, t in enumerate(texts):
        size[sources[i % 5]] += len(words_of(t))
    weight = dict(zip(["a", "b", "only", "é", None], [3, 1, 2, 3, 1], strict=True))
    left, free, target = 1.5 * sum(size.values()), set(sources), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
        free -= full
    for s in sources:
        part = got[got.source.isna() if s is None else got.source == s]
        assert (part.target - target[s]).abs().max() < 1e-6 and (part.source_size == size[s]).all()
        assert abs(part.taken.sum() - target[s]) <= part["size"].max()
    assert (got.taken <= 2 * got["size"]).all() and mixing.mix(spark, empty(spark)).count() == 0


def test_chances_add_up_to_the_goal(spark):
    r = random.Random(3)
    sizes = [r.choice([1, 2, 5, 40, 4000, 90_000]) for _ in range(200)] + [0, 0]
    levels = {}
    for s in sizes:
        w = int(s**0.5 * 1000)
        n, m = levels.get(w, (0, 0))
        levels[w] = n + s, m + w * s
    total, ws = sum(sizes), sum(m for _, m in levels.values())
    for part in (0.1, 0.5, 0.97):
        goals = spark.createDataFrame([("a", ws, part * total), (None, 0, 0.0)], "k string, ws long, goal double")
        rows = spark.createDataFrame([("a", w, n, m) for w, (n, m) in levels.items()] + [(None, 0, 0, 0)], "source_key string, w long, words long, weighed long")
        got = {x.rate_key: x.rate for x in mixing.rates(rows, goals).collect()}
        assert set(got) == {"a"} and sum(s * min(1.0, got["a"] * int(s**0.5 * 1000)) for s in sizes) == pytest.approx(part * total)


def test_taken_rows_of_repeated_ids_and_odd_columns(spark):
    rows = [(i // 3 if i % 7 else None, " ".join(["w"] * (1 + i % 4)), "en", "ab"[i % 2], 1, i, f"x{i}") for i in range(240)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _copies long, row string")
    copies = mixing.mix(spark, frame).toPandas()
    got = mixing.take(spark, frame)
    assert got.columns == frame.columns
    taken = got.toPandas()
    assert len(taken) == copies.copies.sum() and taken.groupby("row").size().max() <= 2
    words = taken.assign(n=taken.text.str.split().str.len()).groupby("source").n.sum()
    assert words.to_dict() == copies.groupby("source").taken.sum().to_dict()
    assert mixing.take(spark, frame.limit(0)).count() == 0


# --- 8: quotations ----------------------------------------------------------------------------------


def test_quotations(spark):
    rows = [(1, 0, "user", "Hello there, friend.\nSecond line"), (1, 1, "assistant", "An answer"), (1, 2, "user", "> Hello THERE friend\n>> nested words\nMy reply"), (1, 3, "user", "> unknown quote\nx"), (2, 0, "user", "> an  ANSWER!\nfrom elsewhere"), (2, 1, "user", None), (3, 0, "user", "nested words"), (None, 0, "user", "x"), (1, 1, "assistant", "An answer")]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("x"))).collect()}
    assert len(got) == 7
    assert (got[1, 2].reply_conv, got[1, 2].reply_turn, got[1, 2].text, got[1, 2].quote_depth, got[1, 2].n_linked) == (1, 0, "My reply", 2, 2)
    assert (got[2, 0].reply_conv, got[2, 0].reply_turn) == (1, 1) and got[1, 3].n_linked == 0 and got[1, 3].reply_turn == 2
    assert [t for _, t in sorted((r.place, t) for (c, t), r in got.items() if c == 1)] == [0, 2, 1, 3] and got[2, 1].text is None


# --- 9: resharding ----------------------------------------------------------------------------------


@given(st.lists(st.integers(0, 50), min_size=1, max_size=5), st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_flow_moves_the_fewest_bytes(sizes, shards):
    ranges = resharding.plan(dict(enumerate(sizes)), shards)
    total = sum(sizes)
    room = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    moved = sum(b - a for o, a, b, j in ranges if o != j)
    assert moved == sum(max(0, s - (room[o] if o < shards else 0)) for o, s in enumerate(sizes))
    assert [sum(b - a for _, a, b, k in ranges if k == j) for j in range(shards)] == room


def test_shards(spark, tmp_path):
    texts = prose(9, 200)
    frame = docs(spark, texts)
    got = resharding.assign(spark, frame).toPandas()
    assert len(got) == len(texts) and (got["size"] == [len((texts[i] or "").encode()) + 1 for i in got.doc_id]).all() and (got.text_crc32 == [zlib.crc32((texts[i] or "").encode()) for i in got.doc_id]).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    by = got.groupby("shard")["size"].sum().reindex(range(8), fill_value=0)
    assert by.max() - by.min() <= 2 * got["size"].max()
    touched = resharding.rewrite(frame, resharding.assign(spark, frame), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == got[got.shard.isin(touched)].shape[0]
    assert resharding.assign(spark, empty(spark)).count() == 0


def test_given_layout_and_capacities(spark, tmp_path):
    rows = [(i, f"t{i} " * (1 + i % 9), i % 5 % 3 if i % 11 else None, i) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot int")
    got = resharding.assign(spark, frame, shards=4, layout="shard", weights=[1, 1, 1, 3]).toPandas()
    old = {i: s or 0 for i, _, s, _ in rows}
    assert (got.old_shard == [old[i] for i in got.doc_id]).all()
    by = got.groupby("shard")["size"].sum()
    assert (by - got["size"].sum() * np.array([1, 1, 1, 3]) / 6).abs().max() <= 2 * got["size"].max()
    stay = got[got.shard == got.old_shard]["size"].sum()
    sizes = got.groupby("old_shard")["size"].sum()
    assert abs(stay - sum(min(sizes[s], got["size"].sum() / 6) for s in range(3))) <= 8 * got["size"].max()
    resharding.rewrite(frame, resharding.assign(spark, frame, shards=4, layout="shard"), str(tmp_path / "o"))
    back = spark.read.parquet(str(tmp_path / "o"))
    assert {"shard", "shard_given", "slot_given"} <= set(back.columns)


# --- 10: Jaccard join -------------------------------------------------------------------------------


@pytest.mark.parametrize(("short", "heavy", "block", "shift", "sent"), [(32, 1 << 19, 1024, 0, 2_000_000), (3, 200, 16, 2**53 - 20, 0), (3, 200, 16, 2**62 + 11, 0), (32, 1 << 19, 1024, -(2**63), 0)])
def test_jaccard_equals_brute_force(spark, monkeypatch, short, heavy, block, shift, sent):
    monkeypatch.setattr(jaccard, "SENT", sent)
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(10)
    v = [f"w{i}" for i in range(500)]
    copy = [r.choice(v) for _ in range(90)]
    texts = prose(10, 40)
    for _ in range(60):
        w = list(copy)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(v)
        texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words_of(t)]
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()})
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    frame = docs(spark, texts).withColumn("doc_id", F.col("doc_id") + F.lit(shift)).unionByName(docs(spark, ["no id a b c", texts[0]]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = jaccard.components(spark, frame.repartition(3)).collect()
    got = {x.doc_id - shift: (x.n_shingles, x.component_id - shift) for x in rows if x.doc_id is not None}
    assert got == {i: (len(sets[i]), root(i)) for i in range(len(texts))}
    assert [x.component_id for x in rows if x.doc_id is None] == [None, None]


def test_chains_of_shared_passages_fall_apart(spark):
    r = random.Random(12)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    compared = []
    for n in (200, 400):
        passages = [words(40) for _ in range(n // 20 + 2)]
        texts = [" ".join(passages[i // 20] + passages[i // 20 + 1] + words(60)) for i in range(n)]
        copies = [" ".join(texts[0].split()[:-1] + [f"end{i}"]) for i in range(70)]  # near copies: more than a list turns into pairs
        sets = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(jaccard.shingles([t.encode() for t in texts + copies]))], "doc long, tokens binary")
        groups = spark.createDataFrame([(i, 0, 0) for i in range(len(texts) + 70)], "doc long, g0 long, g1 long")
        pairs, again = jaccard.regroup(common.Stage(spark, "regroup"), groups, sets, 85)
        sizes = [x["count"] for x in again.groupBy("part").count().collect()]
        assert sizes == [71]
        compared.append(pairs.count() + sum(s * s for s in sizes))
    assert compared[1] <= 1.5 * compared[0]


def test_jaccard_of_an_empty_table(spark):
    assert jaccard.components(spark, empty(spark)).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    frame, columns = common.documents(spark, sf), common.documents(spark, sf).columns
    for name, stage in p.STAGES[:-1]:
        after = common.Stage(spark, "test").write(stage(spark, frame, sf), name)
        assert after.columns == columns
        before_ids, ids = ({r.doc_id for r in x.select("doc_id").collect()} for x in (frame, after))
        assert ids <= before_ids
        if name == "ngram_jaccard":
            assert ids == {r.component_id for r in jaccard.components(spark, frame, p.WORDS, p.PERCENT).collect()}
        if name == "pii":
            assert after.count() == frame.count()
            assert pii.digest(spark, after).filter("n_email + n_phone > 0").count() == 0
        if name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix(spark, frame).collect()}  # ids are unique here
            assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == {d: c for d, c in copies.items() if c}
        frame = after
    packed = p.STAGES[-1][1](spark, frame, sf).toPandas()
    ids = packing.encoder("byte_bpe_50k.tiktoken").encode([(r.text or "").encode() for r in frame.collect()])
    assert packed.length.sum() == sum(map(len, ids)) // 4
