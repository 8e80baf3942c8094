"""Cubic and windowed-sinc resampling and palettes against plain arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolake.operators.raster import geometry as G, palette as L, pointwise as P
from fotolake.plans import actions

RNG = np.random.default_rng(11)


def keys(x):
    x = abs(x)
    return (1.5 * x - 2.5) * x * x + 1 if x < 1 else ((-0.5 * x + 2.5) * x - 4) * x + 2 if x < 2 else 0.0


def lanczos(x):
    return 1.0 if x == 0 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2 if abs(x) < 3 else 0.0


def along(a, target, kernel, stretch):
    """The second axis resampled by a matrix of whole weights."""
    size = a.shape[1]
    unit = max(size, target) if stretch else target
    w = np.array([[math.floor(kernel((2 * target * p - ((2 * t + 1) * size - target)) / (2 * unit)) * 16384 + 0.5) for p in range(size)] for t in range(target)])
    total = np.einsum("tp,hpc->htc", w, a.astype(int))
    return np.clip(np.floor((total + w.sum(1)[None, :, None] // 2) / w.sum(1)[None, :, None]), 0, 255).astype(int)


def resized(a, tw, th, kernel, stretch):
    return along(along(a, tw, kernel, stretch).transpose(1, 0, 2), th, kernel, stretch).transpose(1, 0, 2)


@pytest.mark.parametrize(("name", "kernel", "stretch"), [("bicubic", keys, False), ("antialias", lanczos, True)])
@pytest.mark.parametrize("size", [(23, 31), (5, 3), (17, 4), (1, 40)])
def test_resampling(spark, image, array_of, name, kernel, stretch, size):
    a = RNG.integers(0, 256, (13, 17, 4))
    got = array_of(G.METHODS[name](image(a), *size))
    assert np.array_equal(got, resized(a, *size, kernel, stretch))


def test_methods_are_their_own():
    assert len(set(G.METHODS.values())) == len(G.METHODS)


def test_same_size_and_flat_images_stay(image, array_of):
    a = RNG.integers(0, 256, (6, 7, 3))
    for name in ("bicubic", "antialias"):
        got = array_of(G.METHODS[name](image(a), 7, 6))
        assert np.array_equal(got[:, :, :3], a) and (got[:, :, 3] == -1).all()
        flat = array_of(G.METHODS[name](image(np.full((6, 7, 4), 77)), 20, 3))
        assert (flat == 77).all()


def test_cubic_turn_by_nothing_and_perspective(image, array_of):
    a = RNG.integers(0, 256, (6, 7, 4))
    assert np.array_equal(array_of(G.rotate(image(a), 0, "bicubic")), a)
    out = array_of(G.perspective(image(np.full((9, 9, 4), 200)), "Left", auto_crop=False, resample="bicubic"))
    assert set(np.unique(out)) <= {0, 200}


def test_palette(spark, image, array_of):
    few = np.array([[[10, 0, 0], [10, 0, 0], [200, 0, 0]], [[200, 9, 0], [10, 0, 0], [0, 0, 250]]])
    px = image(few, np.full((2, 3, 3), 5))
    out = L.quantized(px, 256)
    assert np.array_equal(array_of(out)[:, :, :3], few)  # enough entries for all colours
    assert out.filter("image_id = 1").select("p", "r").distinct().collect() == [(0, 5)]
    assert L.palette(px, 1).filter("image_id = 0").select("r", "g", "b").collect() == [((30 + 400) // 6, 9 // 6, 250 // 6)]
    two = {(r.entry, r.r, r.g, r.b) for r in L.palette(px, 2).filter("image_id = 0").collect()}
    # blue has the widest range; below it stay colours up to half of the pixels
    assert two == {(0, 10, 0, 0), (1, 400 // 3, 9 // 3, 250 // 3)}
    with pytest.raises(ValueError):
        L.palette(px, 100)
    assert L.quantized(px.limit(0)).isEmpty()


def test_ties_take_the_first_entry(spark):
    colours = spark.createDataFrame([(1, 10, 10, 10)], "image_id long, r int, g int, b int")
    entries = spark.createDataFrame([(1, 0, 12, 10, 10), (1, 1, 8, 10, 10), (1, 2, 10, 13, 10)], "image_id long, entry int, r int, g int, b int")
    assert L._nearest(colours, entries).select("p", "pr").collect() == [(0, 12)]


def test_modes_of_action_lists(image, array_of):
    a = RNG.integers(0, 256, (4, 5, 4))
    assert set(actions.MODES.values()) == {"1", "L", "LA", "RGB", "RGBA", "P", "CMYK", "YCbCr"}
    assert np.array_equal(array_of(P.as_shown(image(a), "CMYK"))[:, :, :3], a[:, :, :3])
    shown = array_of(P.as_shown(image(a), "YCbCr"))
    assert np.abs(shown[:, :, :3] - a[:, :, :3]).max() <= 3 and (shown[:, :, 3] == -1).all()
    assert P.as_shown(image(a), "P").filter(F.col("a").isNotNull()).isEmpty()
