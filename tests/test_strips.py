"""Packed strips: images of several strips against whole arrays, plans, and the pixel operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolake.operators.raster import core, neighbourhood as N, pointwise as P, strips as R
from fotolake.sources import fixtures as X
from tests.conftest import SF

ID = "image_id long, width int, height int, r array<int>, g array<int>, b array<int>, a array<int>"
SIZES = [(1024, 600), (1500, 400), (7, 5), (3, 900)]


def pictures(bands=4):
    rng = np.random.default_rng(3)
    return {i: rng.integers(0, 256, (h, w, bands)).astype(np.uint8) for i, (w, h) in enumerate(SIZES)}


@pytest.fixture(scope="module")
def strips(spark):
    arrays = pictures()
    rows = [(i, a.shape[1], a.shape[0], *(a[:, :, c].ravel().tolist() for c in range(4))) for i, a in arrays.items()]
    out = R.from_arrays(spark.createDataFrame(rows, ID)).persist()
    assert {r["image_id"]: r["n"] for r in out.groupBy("image_id").agg(F.count("*").alias("n")).collect()} == {0: 3, 1: 3, 2: 1, 3: 1}
    return out


def back(df):
    out = {}
    for r in df.orderBy("image_id", "strip").collect():
        a = np.frombuffer(bytes(r["data"]), np.uint8).reshape(r["rows"], r["width"], r["bands"])
        parts = out.setdefault(r["image_id"], [])
        assert r["y0"] == sum(len(p) for p in parts) and r["rows"] <= R.lines_of(r["width"])
        parts.append(a)
        height = r["height"]
        assert r["y0"] + r["rows"] <= height
    return {i: np.concatenate(p) for i, p in out.items()}


def near(a, size):
    r = size // 2
    p = np.pad(a, ((r, r), (r, r), (0, 0)), "edge").astype(int)
    return np.stack([p[j:j + len(a), i:i + a.shape[1]] for j in range(size) for i in range(size)])


def kernel(a, name):
    w, d, o = N.KERNELS[name]
    size = 5 if len(w) == 25 else 3
    total = (near(a, size) * np.array(w)[:, None, None, None]).sum(0)
    return np.clip(np.floor(total / d) + o, 0, 255).astype(np.uint8)


FILTERS = {
    "median": (R.median, lambda a: np.sort(near(a, 3), 0)[4]),
    "median_5": (lambda d: R.median(d, 5), lambda a: np.sort(near(a, 5), 0)[12]),
    "minimum": (lambda d: R.minimum(d, 5), lambda a: near(a, 5).min(0)),
    "rank": (lambda d: R.rank(d, 3, 25, 60), lambda a: np.floor(a + (np.sort(near(a, 3), 0)[2] - a.astype(float)) * 0.6)),
    "blur": (lambda d: R.effect(d, "blur", repeat=3), lambda a: kernel(kernel(kernel(a, "blur"), "blur"), "blur")),
    "emboss": (lambda d: R.effect(d, "emboss"), lambda a: np.concatenate([kernel(a[:, :, :3], "emboss"), a[:, :, 3:]], 2)),
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_over_strips(strips, name):
    op, plain = FILTERS[name]
    got = back(op(strips))
    for i, a in pictures().items():
        assert np.array_equal(got[i], plain(a)), (name, i)


def test_commonest_over_strips(strips):
    got = back(R.common(strips.filter("image_id >= 2")))
    for i, a in pictures().items():
        if i >= 2:
            n = near(a, 3)
            want = np.zeros(a.shape, int)
            for p in np.ndindex(a.shape):
                values, counts = np.unique(n[(slice(None), *p)], return_counts=True)
                want[p] = values[counts.argmax()]
            assert np.array_equal(got[i], want)


def test_chain_is_one_pass(strips):
    out = R.chain(strips, R.invert(), R.brightness(20), R.posterize(3), R.desaturate(50))
    plan = out._jdf.queryExecution().executedPlan().toString().partition("InMemoryRelation")[0]
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Generate" not in plan
    got = back(out)
    for i, a in pictures().items():
        c = a[:, :, :3].astype(int)
        c = 255 - c
        c = np.floor(c + (255 - c) * 0.2).astype(int)
        c = c & 224
        grey = (c[:, :, 0] * 299 + c[:, :, 1] * 587 + c[:, :, 2] * 114) // 1000
        c = np.floor(c + (grey[:, :, None] - c) * 0.5)
        assert np.array_equal(got[i], np.concatenate([c, a[:, :, 3:]], 2))


def test_mean_of_a_whole_image(strips):
    got = back(R.chain(strips, R.invert(), R.contrast(-100), R.invert()))
    for i, a in pictures().items():
        c = (255 - a[:, :, :3]).astype(int)
        mean = int(((c[:, :, 0] * 299 + c[:, :, 1] * 587 + c[:, :, 2] * 114) // 1000).sum()) // (a.shape[0] * a.shape[1])
        assert (got[i][:, :, :3] == 255 - mean).all() and np.array_equal(got[i][:, :, 3], a[:, :, 3])


@pytest.mark.parametrize("method", ["FLIP_TOP_BOTTOM", "ROTATE_180", "ROTATE_90", "ROTATE_270", "TRANSPOSE", "TRANSVERSE", "FLIP_LEFT_RIGHT"])
def test_turns(strips, method):
    got = back(R.transpose(strips, method))
    for i, a in pictures().items():
        assert np.array_equal(got[i], R._turned(a, method))


def test_shift_and_crop(strips):
    got = back(R.offset(strips, 5, -130))
    cut = back(R.crop(strips, 3, 2, 100, 70))
    for i, a in pictures().items():
        assert np.array_equal(got[i], np.roll(a, (-130 % len(a), 5), (0, 1)))
        want = a[100:len(a) - 70, 3:a.shape[1] - 2]
        assert (i not in cut) if not want.size else np.array_equal(cut[i], want)


def test_single_strips_do_not_move(spark):
    src = R.from_arrays(X.rasters(spark, SF))
    plan = R.median(src)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    got = R.to_pixels(R.median(src)).filter("image_id < 3")
    want = N.median(X.rgba(spark, SF).filter("image_id < 3"))
    assert got.exceptAll(core.integers(want)).isEmpty() and core.integers(want).exceptAll(got).isEmpty()


def test_without_alpha_and_empty(spark):
    rows = [(1, 2, 2, [1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12])]
    src = R.from_arrays(spark.createDataFrame(rows, ID.rpartition(", a")[0]))
    assert R.to_pixels(R.chain(src, R.invert())).filter("a IS NOT NULL").isEmpty()
    assert R.to_pixels(R.chain(src, R.convert_mode("RGBA"))).filter("a = 255").count() == 4
    none = src.limit(0)
    for out in (R.chain(none, R.invert(), R.contrast(-5)), R.median(none), R.transpose(none, "ROTATE_90"), R.to_pixels(none)):
        assert out.isEmpty()


def test_from_pixels(spark):
    px = X.rgba(spark, SF).filter("image_id < 5")
    again = R.to_pixels(R.from_pixels(px))
    assert again.exceptAll(core.integers(px)).isEmpty() and again.count() == px.count()
