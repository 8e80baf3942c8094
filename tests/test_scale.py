"""Order, as-of and per-image joins where one key holds most rows, against brute force."""

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fotolake.operators import catalog as C, geo as G, tags as T
from fotolake.operators.raster import composite as K, core, geometry as Geo, histogram as H, mosaic as M
from fotolake.operators.skew import salted_lookup


def test_indexes_with_one_big_folder(spark):
    rnd = random.Random(1)
    paths = [f"/p/big/{rnd.choice(['IMG', 'img'])}_{i:04d}.jpg" for i in range(3000)]
    paths += [f"/p/{i % 17}/x{i}.jpg" for i in range(300)] + ["/p/big/sub/a.jpg", "/p/big.jpg"]
    rnd.shuffle(paths)
    df = spark.createDataFrame([(p,) for p in paths], "path string").repartition(7)
    got = {r.path: (r.folderindex, r["index"]) for r in C.indexed(df).collect()}
    order = {p: i for i, p in enumerate(sorted(paths))}
    folders = {}
    for p in paths:
        folders.setdefault(p.rsplit("/", 1)[0], []).append(p.rsplit("/", 1)[1])
    for d, names in folders.items():
        for i, n in enumerate(sorted(names, key=lambda s: (s.lower(), s))):
            assert got[f"{d}/{n}"] == (i, order[f"{d}/{n}"])
    assert len(got) == len(paths)


def _time(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.mark.parametrize("direction", ["forward", "nearest"])
def test_asof_with_a_hot_camera(spark, direction):
    rnd = random.Random(2)
    shots = [(i, "hot" if i % 3 else f"c{i % 5}", _time(rnd.randint(0, 5000))) for i in range(2000)]
    shots += [(9001, "no track", _time(5)), (9002, "hot", _time(-100)), (9003, "hot", _time(99999))]
    pts = {("hot" if i % 2 else f"c{i % 5}", _time(rnd.randint(0, 4800))): i for i in range(900)}
    points = [(c, t, float(i), -float(i), 1.0) for (c, t), i in pts.items()]
    sdf = spark.createDataFrame(shots, "shot_id long, camera string, taken timestamp_ntz").repartition(5)
    pdf = spark.createDataFrame(points, "camera string, t timestamp_ntz, lat double, lon double, ele double")
    got = {r.shot_id: r.lat for r in G.geotag(sdf, pdf, direction=direction).collect()}
    by = {}
    for c, t, lat, *_ in sorted(points):
        by.setdefault(c, []).append((t, lat))
    for i, c, t in shots:
        track = by.get(c)
        if not track:
            assert got[i] is None
            continue
        at = bisect.bisect_left([p[0] for p in track], t)
        best = track[min(at, len(track) - 1)]
        if direction == "nearest" and 0 < at:
            before = track[at - 1]
            if at == len(track) or t - before[0] < best[0] - t:
                best = before
        assert got[i] == best[1], (i, c, t)
    assert len(got) == len(shots)


def test_duplicate_track_times_and_signs(spark):
    pts = spark.createDataFrame(
        [("a", _time(1), -10.5, 20.25, -3.0), ("a", _time(1), -11.5, 20.25, -3.0)],
        "camera string, t timestamp_ntz, lat double, lon double, ele double")
    one = G.dedupe_track(pts, "lat")
    assert [r.lat for r in one.collect()] == [-10.5]
    shots = spark.createDataFrame([(1, "a", _time(0))], "shot_id long, camera string, taken timestamp_ntz")
    tagged = G.geotag(shots, one)
    tags = {r.tag: r.value for r in G.gps_tags(tagged).collect()}
    assert tags["Exif_GPSInfo_GPSLatitude"] == "10/1 30/1 0/1" and tags["Exif_GPSInfo_GPSLatitudeRef"] == "S"
    assert tags["Exif_GPSInfo_GPSAltitude"] == "30/10" and tags["Exif_GPSInfo_GPSAltitudeRef"] == "1"
    assert G.gps_report(tagged).first()["elev"] == "  -3.0"


def test_salted_lookup(spark):
    big = spark.range(1000).select("id", F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"))
    small = spark.createDataFrame([(1, "hot"), (950, "x")], "k long, v string")
    got = salted_lookup(big, small, ["k"], F.col("id"), "left")
    assert got.count() == 1000 and got.filter("v = 'hot'").count() == 900 and got.filter("v = 'x'").count() == 1


def test_per_image_joins_over_several_tiles(spark, image, array_of, monkeypatch):
    """A small tile size makes one image span many join keys."""
    import numpy as np

    monkeypatch.setattr(core, "TILE", 10)
    monkeypatch.setattr(core, "STRIP", 10)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (9, 7, 4))
    a[:, :3, 3] = 0
    df = image(a, rng.integers(0, 256, (2, 2, 4)))
    eq = array_of(H.equalize(df))
    for c in range(3):
        values, counts = np.unique(a[:, :, c], return_counts=True)
        cdf = dict(zip(values, counts.cumsum()))
        first = counts[0]
        assert all(eq[y, x, c] == 255 * (cdf[a[y, x, c]] - first) // (63 - first) for y in range(9) for x in range(7))
    cropped = array_of(Geo.crop_auto(df))
    ys, xs = np.nonzero(a[:, :, 3])
    assert (cropped == a[ys.min():ys.max() + 1, xs.min():xs.max() + 1]).all()
    strips = core.pack_strips(df)
    assert strips.filter("image_id = 0").count() == 9  # one line each
    back = core.integers(strips.select(
        "image_id", "width", "height", "y0", "bands", F.posexplode("data").alias("i", "v")).withColumn(
        "x", F.floor(F.col("i") / 4) % F.col("width")).withColumn("y", F.col("y0")).groupBy(
        "image_id", "width", "height", "x", "y").agg(*[
            F.max(F.when(F.col("i") % 4 == n, F.col("v"))).alias(c) for n, c in enumerate("rgba")]))
    assert (array_of(back) == a).all()


@pytest.mark.parametrize("grid", [1, 2])
def test_mosaic_is_the_exact_nearest(spark, image, grid):
    import numpy as np

    rng = np.random.default_rng(4)
    fills = [rng.integers(0, 256, (4, 4, 3)) for _ in range(40)] + [np.full((4, 4, 3), 200)] * 20  # many copies
    pics = [rng.integers(0, 256, (9, 7, 3)), np.full((6, 6, 3), 199), rng.integers(90, 110, (5, 5, 3))]
    got = M.section_fills(image(*pics), image(*fills), cols=3, rows=2, grid=grid).collect()
    assert len(got) == 3 * 6

    def feature(a):
        h, w, _ = a.shape
        ys = [[max(0, min((y + 1) * grid, (c + 1) * h) - max(y * grid, c * h)) for y in range(h)] for c in range(grid)]
        xs = [[max(0, min((x + 1) * grid, (c + 1) * w) - max(x * grid, c * w)) for x in range(w)] for c in range(grid)]
        return [int(sum(a[y, x, b] * ys[cy][y] * xs[cx][x] for y in range(h) for x in range(w)) * 16
                    // sum(ys[cy][y] * xs[cx][x] for y in range(h) for x in range(w)))
                for cy in range(grid) for cx in range(grid) for b in range(3)]

    known = [feature(f) for f in fills]
    for r in got:
        a = pics[r.image_id]
        h, w, _ = a.shape
        part = a[r["row"] * h // 2:(r["row"] + 1) * h // 2, r["col"] * w // 3:(r["col"] + 1) * w // 3]
        f = feature(part)
        best = min((sum(abs(p - q) for p, q in zip(f, g)), i) for i, g in enumerate(known))
        assert (r.distance, r.fill_id) == best


def test_broadcast_only_within_a_checked_size(spark, image):
    import numpy as np

    stamp = K.Stamp.of(image(np.full((2, 2, 4), 255)).drop("image_id"))
    df = image(np.zeros((4, 4, 4), int))
    small = K.watermark(df, stamp, "Tile")
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    K_limit, K.STAMP_PIXELS = K.STAMP_PIXELS, 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        large = K.watermark(df, stamp, "Tile")
        assert "BroadcastHashJoin" not in large._jdf.queryExecution().executedPlan().toString()
        assert sorted(large.collect()) == sorted(small.collect())
    finally:
        K.STAMP_PIXELS = K_limit
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tag_edges(spark):
    df = spark.sql("SELECT 1L AS image_id, timestamp_ntz'2024-01-31 10:00:00' AS mtime, "
                   "map('Exif_Image_Make', 'x', 'Exif_Photo_FNumber', '28/10', 'Iptc_A_B', '1 2 3') AS tags")
    long = lambda d: {r.tag: r.value for r in T.to_long(d).collect()}
    assert "Exif_Image_Make" not in long(T.write_tag(df, "Exif_Image_Make", " "))
    assert long(T.rename_tag(df, "Exif_None_X", "Exif_New_X")) == long(df)
    assert long(T.rename_tag(df, "Exif_Image_Make", "Iptc_A_B"))["Iptc_A_B"] == "x"
    assert T.to_long(T.delete_tags(df)).count() == 0
    e = {r.tag: r.value for r in T.expand_tags(T.to_long(df)).collect()}
    assert e["Exif_Photo_FNumber.numerator"] == "28" and e["Iptc_A_B[2]"] == "3"
    shifted = T.time_shift(df, months=1)
    assert long(shifted)["Exif_Image_DateTime"] == "2024:02:29 10:00:00"
    assert str(shifted.first()["mtime"]) == "2024-02-29 10:00:00"
    assert T.used_tags(T.to_long(df)).count() == 3
    back = T.to_map(T.to_long(df)).first()["tags"]
    assert back == df.first()["tags"]
    assert {r.tag for r in T.select_tags(T.to_long(df), "Iptc").collect()} == {"Iptc_A_B"}
    assert T.transpose_matrix(T.to_long(df), [1]).count() == 3
