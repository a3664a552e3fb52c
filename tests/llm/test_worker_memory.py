"""What a Python worker keeps after a task: it lives on, and its memory counts in all later stages."""

import numpy as np

from reprolens.llm import common, packing


def test_power_tables_stay_small(monkeypatch):
    monkeypatch.setattr(common, "_POWERS", {})
    rng = np.random.default_rng(5)
    letters = rng.choice(list(b"abcdefgh     "), 3 << 20).astype(np.uint8).tobytes()
    raw = [letters[a : a + 3000] for a in range(0, len(letters), 3000)]
    found = packing.spans(raw)
    assert sum(x.nbytes for kept in common._POWERS.values() for x in kept) <= 1 << 25
    # The same strings and hashes, however the texts are grouped.
    for a, b in zip(found, packing.spans(raw, limit=1 << 22), strict=True):
        assert (a == b).all()
    strings = b" ".join(raw).split(b" ")
    assert found[1].tolist() == list(map(len, strings))


def test_long_tables_are_right_and_not_kept(monkeypatch):
    monkeypatch.setattr(common, "_POWERS", {})
    n = common.KEPT + 5
    power, inverse = common.powers(n)
    assert len(power) >= n and len(inverse) >= n
    assert (power * inverse == 1).all()
    assert not common._POWERS
    assert (common.powers(1000)[0] == power[: len(common.powers(1000)[0])]).all() and len(common._POWERS) == 1
