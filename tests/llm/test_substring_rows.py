"""Substring dedup of tables whose ids repeat."""

import hashlib
import random

import pytest

from reprolens.llm import substring_dedup
from reprolens.llm.common import Stage


def test_repeated_ids(spark):
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(10_000)}" for _ in range(n)]
    alone, part, long, short = words(40), words(30), words(60), words(25)
    texts = [(1, alone)] * 3 + [(2, part + long), (2, short + part), (3, words(5) + part), (3, short), (4, words(50)), (5, part + words(3)), (5, long), (None, alone), (None, part), (6, []), (6, None)]
    rows = [(i, None if w is None else " ".join(w)) for i, w in texts]
    seen, gone = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda x: (x[0], hashlib.sha256(x[1].encode()).hexdigest())):
        w, out = t.split(), set()
        for s in range(len(w) - 19):
            edge = tuple(w[s : s + 20])
            if edge in seen:
                out.update(range(s, s + 20))
            seen.add(edge)
        gone[i, t] = out
    want = []
    for i, t in rows:
        w, out = (t or "").split(), gone.get((i, t or ""), set())
        want.append((i or 0, len(w), len(out), " ".join(x for k, x in enumerate(w) if k not in out)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring_dedup.dedup(spark, frame).collect()
    assert sorted((x.doc_id or 0, x.n_words, x.n_removed, x.kept) for x in got) == sorted(want)
    assert sum(x.kept == " ".join(alone) for x in got) == 4 and any(x.n_removed for x in got)
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append((t or "").split())
    cut = [(x, p) for x in got for p in x.paths]
    assert cut
    for x, p in cut:
        taken = [w[p.start : p.start + p.words] for w in by_id[x.doc_id] if len(w) == x.n_words]
        assert any(s[p.source_start : p.source_start + p.words] in taken for s in by_id[p.source_doc])
    brief = substring_dedup.digest(spark, frame).collect()
    assert sorted((x.doc_id or 0, x.n_words, x.n_removed) for x in brief) == sorted(x[:3] for x in want)


def unitigs(texts, k):
    """Sets of repeated edges on one nonbranching path, by plain dictionaries."""
    places, after, before = {}, {}, {}
    lists = [t.split() for t in texts]
    for i, w in enumerate(lists):
        for s in range(len(w) - k + 1):
            places.setdefault(tuple(w[s : s + k]), []).append((i, s))
    repeated = {e for e, at in places.items() if len(at) > 1}
    for w in lists:
        for s in range(len(w) - k):
            e, f = tuple(w[s : s + k]), tuple(w[s + 1 : s + 1 + k])
            if e in repeated and f in repeated:
                after.setdefault(e, set()).add(f)
                before.setdefault(f, set()).add(e)
    parent = {e: e for e in repeated}

    def root(e):
        while parent[e] != e:
            e = parent[e]
        return e

    for e, nexts in after.items():
        for f in nexts:
            if len(nexts) == 1 and len(before[f]) == 1:
                parent[root(e)] = root(f)
    groups = {}
    for e in repeated:
        groups.setdefault(root(e), set()).add(min(places[e]))
    return sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize("seed", range(4))
def test_paths_equal_unitigs(spark, seed):
    r = random.Random(seed)
    parts = [" ".join(f"w{r.randrange(40)}" for _ in range(r.randint(4, 14))) for _ in range(9)]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(1, 6))) for _ in range(40)] + ["loop " * 30, "loop " * 12, "a b " * 15, "b a " * 9]
    stage = Stage(spark, "unitigs")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(5)
    spans, compact = substring_dedup.graph(spark, stage, frame, 6, 3, 3)
    got = {}
    for p in compact.collect():
        got.setdefault(tuple(p.path), []).extend((p.doc, p.start + i) for i in range(p["count"]))
    assert sorted(sorted(g) for g in got.values()) == unitigs(texts, 6)
    first = {}
    for i, t in enumerate(texts):
        w = t.split()
        for s in range(len(w) - 5):
            first.setdefault(tuple(w[s : s + 6]), (i, s))
    want = {(i, s): first[tuple(w[s : s + 6])] for i, t in enumerate(texts) for w in [t.split()] for s in range(len(w) - 5) if first[tuple(w[s : s + 6])] != (i, s)}
    found = [((x.doc, x.start + i), (x.source_doc, x.source_start + i)) for x in spans.collect() for i in range(x["count"])]
    assert len(found) == len(dict(found)) and dict(found) == want


def test_spans_whose_words_differ_are_dropped(spark):
    texts = spark.createDataFrame([(0, "a b c d e f g i"), (1, "x a b c d e f"), (2, "a b c q e f g h")], "doc long, text string")
    runs = spark.createDataFrame([(1, 1, 0, 0, 3), (2, 0, 0, 0, 3), (2, 4, 0, 4, 1)], substring_dedup.RUN)
    good = substring_dedup.verified(Stage(spark, "verified"), texts, runs, 4, 2).collect()
    assert [(x.doc, x.start) for x in good if x["count"]] == [(1, 1)]


def test_null_ids_empty_and_long_texts(spark):
    words = [f"w{i}" for i in range(20_000)]
    rows = [(None, " ".join(words)), (None, None), (1, " ".join(words)), (2, " ".join(words[5000:5040])), (3, ""), (4, None), (5, " ".join(words[:19]))]
    got = {r.doc_id: r for r in substring_dedup.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is not None}
    assert {i: (r.n_words, r.n_removed) for i, r in got.items()} == {1: (20_000, 0), 2: (40, 40), 3: (0, 0), 4: (0, 0), 5: (19, 0)}
    assert got[2].paths[0].source_start == 5000 and got[2].kept == ""
