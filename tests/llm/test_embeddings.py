"""Near-duplicate vectors in cells of cut labels, against brute force."""

from math import log

import numpy as np
import pytest

from reprolens.llm import embed_dedup


def brute(x, label, cosine=0.93):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= cosine) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[i], *root[np.flatnonzero(link[i])], root[i]) for i in range(len(x))])
        if (new == root).all():
            return link, root
        root = new


def data(n, dim, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    for i in range(n // 3):  # copies from near to just above or below the threshold
        a, b = r.integers(0, n, 2)
        x[b] = x[a] + r.normal(size=dim) * r.choice([0.0, 0.05, 0.2, 0.35, 0.38, 0.42])
    return x.astype(np.float32).astype(np.float64), (r.random(n) < 0.8).astype(int)


@pytest.mark.parametrize(("cell", "block"), [(40, 30), (40, 2048), (2048, 2048)])
def test_cut_labels_equal_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embed_dedup, "CELL", cell)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    x, label = data(900, 24, 5)
    link, root = brute(x, label)
    rows = [(i, [float(c) for c in v], int(lab)) for i, (v, lab) in enumerate(zip(x, label, strict=True))]
    got = embed_dedup.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(6)).collect()
    got = {r.vec_id: r for r in got}
    links = np.array([got[i].n_links for i in range(len(x))])
    assert links.sum() >= 0.999 * link.sum() and (links <= link.sum(axis=1)).all()
    assert np.mean([got[i].component_id == root[i] for i in range(len(x))]) > 0.995


def test_each_pair_counts_in_one_cell():
    x, _ = data(600, 16, 9)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    cuts = embed_dedup.place_cuts(list(u), 0.93)
    n = 5
    sides = [cuts.sides(u, t, n) for t in range(cuts.tables(n))]
    where = [[set() for _ in u] for _ in sides]
    for t, (low, high) in enumerate(sides):
        for i, c in zip(*(v.tolist() for v in embed_dedup.cells(low, high, n)), strict=True):
            where[t][i].add(c)
    close = np.argwhere(np.triu(u @ u.T >= 0.93, 1))
    found = sum(any(w[a] & w[b] for w in where) for a, b in close)
    assert found >= 0.999 * len(close)
    for a, b in close[:200]:
        t = next((t for t, w in enumerate(where) if w[a] & w[b]), None)
        if t is not None:
            assert min(where[t][a] & where[t][b]) == sides[t][1][a] | sides[t][1][b]


def test_comparisons_grow_little_faster_than_vectors():
    r = np.random.default_rng(1)
    u = r.normal(size=(embed_dedup.SAMPLE, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    cuts = embed_dedup.place_cuts(list(u), 0.93)

    def pairs(n):  # compared for each vector
        k = cuts.cuts(max(0, int(np.ceil(log(n / embed_dedup.CELL) / -log(cuts.side)))))
        return cuts.tables(k) * (2 * cuts.side**2) ** k * n

    assert pairs(1e6) < 6 * pairs(1e5) and pairs(1e5) < 0.5 * 1e5 and pairs(1e6) < 0.15 * 1e6


def test_equal_vectors_are_one_with_a_weight(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(500)] + [(900, [1.0, 2.0, 3.1], 1), (901, [-1.0, 0.0, 0.0], 1), (902, [1.0, None, 2.0, 3.0], 1), (903, [1.0, 2.0, 3.0], None), (904, [0.0, 0.0], 1), (905, [0.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**{i: (500, 0) for i in range(500)}, 900: (500, 0), 901: (0, 901), 902: (0, 902), 903: (0, 903), 904: (0, 904), 905: (0, 905)}


def test_cuts_come_from_all_vectors(spark):
    """Rows in two places far apart: the counts of each half differ, those of the table are their sum."""
    from reprolens.llm.common import Stage

    r = np.random.default_rng(9)
    u = np.concatenate([r.normal(size=(2500, 8)) + 2, r.normal(size=(2500, 8)) - 1])
    u = (u / np.linalg.norm(u, axis=1)[:, None]).astype(np.float64)
    unit = spark.createDataFrame([(0, 8, bytearray(v.tobytes())) for v in u], "label int, dim int, x binary").repartition(5)
    cuts = embed_dedup.measured_cuts(Stage(spark, "cuts"), unit, unit.groupBy("label", "dim").count(), 0.93, "<f8")
    want = embed_dedup.place_cuts(list(u), 0.93)
    deep = np.flatnonzero(cuts.medians[8].any(axis=0)).max() + 1
    assert deep >= 3 and np.array_equal(cuts.medians[8][:, :deep], want.medians[8][:, :deep])
    p = u @ embed_dedup.directions(8, embed_dedup.DEEPEST, embed_dedup.SEED + 1)[:, :deep]
    assert np.abs(np.median(p, axis=0) - cuts.at(8, 0)[:deep]).max() <= embed_dedup.BIN
