"""Properties and numpy checks, on images that cross line blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolake.operators.raster import composite as K, core, geometry as G, histogram as H
from fotolake.operators.raster import neighbourhood as N, pointwise as P

RNG = np.random.default_rng(0)


def rgba(h, w):
    return RNG.integers(0, 256, (h, w, 4))


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (6, 4)])
def test_identities(image, array_of, shape):
    a = rgba(*shape)
    df = image(a)
    same = {
        "invert twice": P.invert(P.invert(df)),
        "four turns": G.transpose(G.transpose(G.transpose(G.transpose(df, "ROTATE_90"), "ROTATE_90"), "ROTATE_90"), "ROTATE_90"),
        "flip twice": G.transpose(G.transpose(df, "FLIP_LEFT_RIGHT"), "FLIP_LEFT_RIGHT"),
        "turn and back": G.transpose(G.transpose(df, "ROTATE_90"), "ROTATE_270"),
        "offset by size": G.offset(df, F.col("width"), F.col("height")),
        "crop of canvas": G.crop(G.canvas(df, F.col("width") + 4, F.col("height") + 6), "Custom", 0, 2, 2, 3, 3),
        "blend 0": P.invert(df, 0),
        "scale 1:1 area": G.scale_area(df, F.col("width"), F.col("height")),
        "scale 1:1 bilinear": G.scale_bilinear(df, F.col("width"), F.col("height")),
        "scale 1:1 nearest": G.scale_nearest(df, F.col("width"), F.col("height")),
        "turn by 360": G.rotate(df, 360),
        "no thumbnail growth": G.thumbnail(df, 100),
        "border 0": K.border(df, 0),
    }
    for name, out in same.items():
        assert (array_of(out) == a).all(), name


def test_turn_matches_numpy_and_tags(image, array_of):
    a = rgba(3, 5)
    df = image(a)
    assert (array_of(G.transpose(df, "ROTATE_90")) == np.rot90(a)).all()
    assert (array_of(G.rotate(df, 90, expand=True)) == np.rot90(a)).all()
    assert (array_of(G.rotate(df, 180)) == a[::-1, ::-1]).all()
    for tag in range(1, 9):
        up = G.orient(df, F.lit(tag))
        assert (array_of(G.orient(up, F.lit(tag), back=True)) == a).all()
    assert (array_of(G.orient(df, F.lit(6))) == np.rot90(a, -1)).all()


def test_no_alpha_stays_so(image, array_of):
    a = RNG.integers(0, 256, (5, 4, 3))
    df = image(a)
    outs = [P.invert(df), N.median(df), N.effect(df, "blur"), G.scale_area(df, 2, 2), G.canvas(df, 6, 6),
            H.equalize(df), K.border(df, 1), N.common(df), G.grid(df, 2, 1, 1)]
    for out in outs:
        assert (array_of(out)[:, :, 3] == -1).all()


def _windows(a, size):
    r = size // 2
    p = np.pad(a, ((r, r), (r, r), (0, 0)), mode="edge")
    return np.stack([p[dy:dy + a.shape[0], dx:dx + a.shape[1]] for dy in range(size) for dx in range(size)])


@pytest.fixture(scope="module")
def tall():
    return RNG.integers(0, 256, (140, 9, 4))


@pytest.mark.parametrize("size", [3, 5])
def test_rank_filters_over_blocks(image, array_of, tall, size):
    df, w = image(tall), _windows(tall, size)
    n = size * size
    assert (array_of(N.minimum(df, size)) == w.min(0)).all()
    assert (array_of(N.maximum(df, size)) == w.max(0)).all()
    assert (array_of(N.median(df, size)) == np.sort(w, 0)[n // 2]).all()
    assert (array_of(N.rank(df, size, 25)) == np.sort(w, 0)[int((n - 1) * 0.25)]).all()
    modes = np.apply_along_axis(lambda v: np.bincount(v, minlength=256).argmax(), 0, w)
    assert (array_of(N.common(df, size)) == modes).all()


@pytest.mark.parametrize("kernel", ["blur", "sharpen", "emboss"])
def test_repeated_kernels_over_blocks(image, array_of, tall, kernel):
    weights, div, off = N.KERNELS[kernel]
    size = 5 if len(weights) == 25 else 3
    want = tall.copy()
    for _ in range(3):
        w = _windows(want, size)
        total = sum(int(k) * w[i].astype(int) for i, k in enumerate(weights))
        new = np.clip(np.floor(total / div) + off, 0, 255).astype(int)
        if kernel in N.KEEP_ALPHA:
            new[:, :, 3] = tall[:, :, 3]
        want = new
    assert (array_of(N.effect(image(tall), kernel, repeat=3)) == want).all()


def test_filters_shuffle_once(image):
    plan = N.effect(image(rgba(4, 4)), "blur", repeat=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_pointwise_and_exact_geometry_do_not_shuffle(image):
    df = image(rgba(4, 4))
    for out in (P.invert(df), P.saturation(df), P.warm_up(df), G.transpose(df, "ROTATE_90"), G.offset(df, 1, 1),
                G.mirror(df), G.grid(df, 2, 2, 1, 1), G.canvas(df, 9, 9), G.scale_nearest(df, 7, 3), G.rotate(df, 30),
                K.border(df, 2), K.round_corners(df, 2), K.reflection(df, 2), K.checkerboard(df)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_area_matches_numpy(image, array_of):
    a = rgba(6, 9)
    out = array_of(G.scale_area(image(a), 3, 2))
    want = np.floor(a.reshape(2, 3, 3, 3, 4).mean((1, 3)) + 1e-9).astype(int)
    assert (out == want).all()


def test_targets_much_larger_and_smaller_than_the_source(image, array_of):
    a = rgba(2, 3)
    big = array_of(G.canvas(image(a), 40, 33, color="#010203"))
    assert (big[15:17, 18:21] == a).all() and (big[0, 0] == [1, 2, 3, 0]).all()
    tiny = array_of(G.canvas(image(rgba(9, 9)), 2, 1))
    assert tiny.shape == (1, 2, 4)
    assert array_of(G.scale_bilinear(image(a), 31, 1)).shape == (1, 31, 4)


def test_edge_images(image, array_of):
    flat = np.full((4, 4, 4), 77)
    df = image(flat)
    assert (array_of(H.autocontrast(df)) == flat).all()
    assert (array_of(H.equalize(df)) == flat).all()
    clear = flat.copy()
    clear[:, :, 3] = 0
    assert (array_of(G.crop_auto(image(clear))) == clear).all()
    out = array_of(P.color_to_alpha(image(np.full((1, 1, 4), 255))))
    assert out[0, 0, 3] == 0


def test_reduced_opacity(image, array_of):
    assert array_of(P.reduce_opacity(image(np.full((1, 1, 3), 255)), 50))[0, 0].tolist() == [255, 255, 255, 127]


def test_rotation_blend_and_perspective_cover_the_canvas(image, array_of):
    df = image(rgba(7, 11))
    for out in (G.rotate(df, 33, "bilinear", amount=40), G.rotate(df, 33, expand=True, color="#ff0000", opacity=30),
                G.perspective(df, "Corner Bottom Right", auto_crop=False), G.perspective(df, "Top"),
                G.perspective(df, "Right Stretched", auto_crop=False, resample="linear"),
                G.transpose(df, "ROTATE_90", 50)):
        array_of(out)


def test_straight_perspective_is_the_image(image, array_of):
    a = rgba(5, 6)
    plain = (100, 0, 0, 0, 0, 0, 0, "NONE")
    assert (array_of(G.perspective(image(a), auto_crop=False, user=plain)) == a).all()


def test_shadow_without_alpha_and_blurred_reflection(image, array_of):
    a = RNG.integers(0, 256, (6, 5, 3))
    s = array_of(K.shadow(image(a), 2, 1, 3, 2))
    assert s.shape == (13, 13, 4) and (s[3:9, 3:8, :3] == a).all() and (s[0, 0, :3] == 255).all()
    for kw in ({"blur": True}, {"scale": True}, {"scale": True, "blur": True}):
        r = array_of(K.reflection(image(a), F.floor(F.col("height") / 2), 1, **kw))
        assert r.shape == (10, 5, 4)


def test_grid_scaled_and_mirror(image, array_of):
    a = rgba(8, 8)
    assert array_of(G.grid(image(a), 2, 2, scale=True)).shape == (8, 8, 4)
    m = array_of(G.mirror(image(a), "Horizontal"))
    assert (m[:, 8:] == a[:, ::-1]).all()


def test_unpack(spark):
    df = spark.createDataFrame([(1, 2, 1, 2, [5, 6, 7, 8]), (2, 1, 1, 1, [9])],
                               "image_id long, width int, height int, bands int, data array<int>")
    got = {(r.image_id, r.x): (r.r, r.g, r.b, r.a) for r in core.unpack(df).collect()}
    assert got == {(1, 0): (5, 5, 5, 6), (1, 1): (7, 7, 7, 8), (2, 0): (9, 9, 9, None)}
