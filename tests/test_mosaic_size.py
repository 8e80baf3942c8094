"""The closest fill of many sections and fills: exact, and without a row for a pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolake.operators.raster import mosaic as M


def features(spark, tones, key):
    rows = [(i, [int(v) for v in t]) for i, t in enumerate(tones)]
    return spark.createDataFrame(rows, f"{key} long, f array<int>")


def all_pairs(sections, fills):
    """The least (distance, number) over the colours that both have."""
    has = (sections >= 0)[:, None] & (fills >= 0)[None]
    d = np.where(has, np.abs(sections[:, None] - fills[None]), 0).sum(2)
    d = np.where(has.any(2), d, 1 << 40)
    return [(int(d[i, j]), int(j)) if d[i, j] < 1 << 40 else None for i, j in enumerate(d.argmin(1))]


def test_no_pair_is_a_row(spark):
    some = features(spark, np.arange(24).reshape(2, 12), "fill_id")
    plan = M.nearest(some.select("f"), some, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("tones", [12, 27])
@pytest.mark.parametrize("spread", [4, 900])
def test_closest_is_the_least_of_all_pairs(tones, spread):
    rng = np.random.default_rng(tones + spread)
    at = rng.integers(0, 3000, (12, tones))
    make = lambda n: at[rng.integers(0, 12, n)] + rng.integers(0, spread, (n, tones))
    sections, fills = make(M.STEP + 90), make(3 * M.LEAF + 7)
    fills[-40:] = fills[:40]
    best, first = M.closest(sections.T, fills.T)
    assert list(zip(best.tolist(), first.tolist())) == all_pairs(sections, fills)


def test_tiles_and_blocks_meet(spark, monkeypatch):
    for name, value in {"TILES": 3, "SECTIONS": 40, "FILLS": 25}.items():
        monkeypatch.setattr(M, name, value)
    rng = np.random.default_rng(1)
    sections, fills = rng.integers(0, 4081, (300, 12)), rng.integers(1900, 2100, (120, 12))
    sections[200:] = sections[:100]
    fills[60:80] = fills[:20]
    for part in (sections, fills):  # some lack colours, and the last ones have a single one
        part[::7, 0::3] = M.ABSENT
        part[::11, 1::3] = M.ABSENT
    sections[5, 0::3] = sections[5, 1::3] = sections[5, 2::3] = M.ABSENT
    found = M.nearest(features(spark, sections, "section").select("f"), features(spark, fills, "fill_id"), 2).collect()
    want = {tuple(s): w for s, w in zip(sections.tolist(), all_pairs(sections, fills)) if w}
    assert {tuple(r.f): (r.distance, r.fill_id) for r in found} == want and len(found) == len(want)
    assert sum(r.n for r in found) == 299


@pytest.mark.parametrize("hot", [1, 1 << 16])
def test_a_feature_of_many_sections(spark, image, monkeypatch, hot):
    monkeypatch.setattr(M, "HOT", hot)
    flat, other = np.full((8, 8, 3), 90), np.arange(192).reshape(8, 8, 3)
    got = M.section_fills(image(flat, other), image(flat, other), 4, 4)
    assert got.count() == 32 == got.select("image_id", "col", "row").distinct().count()
    assert got.filter("image_id = 0").agg(F.max("distance"), F.max("fill_id")).first() == (0, 0)
