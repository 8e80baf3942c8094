"""Pixel differences by tile digests against whole arrays."""

import numpy as np
import pytest

from fotolake.operators import diff as D

RNG = np.random.default_rng(2)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_differences(spark, image, monkeypatch, broadcast):
    monkeypatch.setattr(D, "OPEN_TILES", broadcast)
    a = RNG.integers(0, 256, (150, 130, 4))
    b = a.copy()
    b[100, 70, 1] ^= 9
    b[101, 70, 2] ^= 200
    px, other = image(a, a, a[:40, :40, :3]), image(a, b, a[:40, :39, :3])
    got = {r.image_id: (r.difference, r.pixels) for r in D.max_difference(px, other).collect()}
    gap = np.abs(a - b).max(2)
    assert got == {0: (0, 0), 1: (gap.max(), (gap > 0).sum()), 2: (255, 40)}
    status = {r.image_id: r.status for r in D.corpus_diff(px, other).collect()}
    assert status == {0: "same", 1: "mismatch: pixels", 2: "mismatch: size"}


def test_equal_tiles_stay_where_they_are(spark, image):
    """One tile of six differs; only its pixels pass the filter below the shuffle."""
    a = RNG.integers(0, 256, (150, 130, 3))
    b = a.copy()
    b[149, 0, 0] ^= 1
    first, second = image(a).persist(), image(b).persist()
    tiles = D.open_tiles(first, second)
    assert [(r["_ty"], r["_tx"]) for r in tiles.filter("differs").collect()] == [(2, 0)] and tiles.count() == 9
    out = D.max_difference(first, second)
    assert [(r.difference, r.pixels) for r in out.collect()] == [(1, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("LeftSemi") == 2
    before = plan[plan.index("LeftSemi"):]
    assert "Exchange hashpartitioning(image_id" not in before.split("LeftSemi")[1].split("InMemoryTableScan")[0]


def test_nothing_to_compare(spark, image):
    none = image(RNG.integers(0, 256, (2, 2, 3))).limit(0)
    assert D.max_difference(none, none).isEmpty() and D.corpus_diff(none, none).isEmpty()
