"""The two forms of the as-of join give the same points."""

import random

import pytest

from fotolake.operators import geo as G
from pyspark.sql import functions as F


def tables(spark, n=300):
    rnd = random.Random(8)
    points = sorted({(rnd.randrange(4), rnd.randrange(200)) for _ in range(n)})
    shots = [(i, rnd.choice([0, 1, 2, 3, 9, None]), rnd.randrange(-20, 220)) for i in range(n)]
    at = lambda c: F.timestamp_seconds(F.lit(1_700_000_000) + F.col(c))
    p = spark.createDataFrame([(c, t, float(i), float(-i), 1.0) for i, (c, t) in enumerate(points)], "camera int, s int, lat double, lon double, ele double")
    s = spark.createDataFrame(shots, "shot_id int, camera int, s int")
    return s.select("shot_id", "camera", at("s").alias("taken")), p.select("camera", at("s").alias("t"), "lat", "lon", "ele")


@pytest.mark.parametrize("direction", ["forward", "nearest"])
def test_broadcast_equals_sorted(spark, direction):
    shots, points = tables(spark)
    want = {r.shot_id: tuple(r) for r in G.geotag(shots, points, 7, direction).collect()}
    out = G.geotag_broadcast(shots, points, 7, direction)
    assert {r.shot_id: tuple(r) for r in out.collect()} == want and len(want) == 300
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_chosen_by_counting(spark, monkeypatch):
    shots, points = tables(spark, 50)
    monkeypatch.setattr(G, "SMALL_TRACK", points.count())
    assert G.small_tracks(points) is not None
    monkeypatch.setattr(G, "SMALL_TRACK", points.count() - 1)
    assert G.small_tracks(points) is None
    want = {r.shot_id: tuple(r) for r in G.geotag(shots, points).collect()}
    assert {r.shot_id: tuple(r) for r in G.geotag_broadcast(shots, points).collect()} == want
    assert G.geotag_broadcast(shots, points.limit(0)).filter("gps_time IS NOT NULL").isEmpty()
