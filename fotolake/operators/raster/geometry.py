"""Geometry: pixels move by key arithmetic.

A source pixel computes which target pixels show it, so crops, copies, scaling and
rotation need no gather join; only averaging (one sum per target pixel) and the
projective map shuffle.  Weights are whole numbers, so results do not depend on the
order of the sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.pixels import RGBA, as_column, blend, over, rgb_of
from ...functions.units import fit_inside
from . import core, histogram as H


def _c(name: str) -> Column:
    return F.col(name)


def moved(df: DataFrame, x: Column, y: Column, width: Column | int, height: Column | int, keep=()) -> DataFrame:
    """New position and size in one projection."""
    return core.integers(df.select(
        "image_id", as_column(width).alias("width"), as_column(height).alias("height"),
        x.alias("x"), y.alias("y"), *RGBA, *keep), keep)


# ---- exact permutations ----

def _steps():
    x, y, w, h = _c("x"), _c("y"), _c("width"), _c("height")
    return {
        "NONE": (x, y, False),
        "FLIP_LEFT_RIGHT": (w - 1 - x, y, False),
        "FLIP_TOP_BOTTOM": (x, h - 1 - y, False),
        "ROTATE_180": (w - 1 - x, h - 1 - y, False),
        "ROTATE_90": (y, w - 1 - x, True),
        "ROTATE_270": (h - 1 - y, x, True),
        "TRANSPOSE": (y, x, True),
        "TRANSVERSE": (h - 1 - y, w - 1 - x, True),
    }


# The step that turns an image with orientation tag 1..8 upright.
UPRIGHT = {1: "NONE", 2: "FLIP_LEFT_RIGHT", 3: "ROTATE_180", 4: "FLIP_TOP_BOTTOM",
           5: "TRANSPOSE", 6: "ROTATE_270", 7: "TRANSVERSE", 8: "ROTATE_90"}
INVERSE = {"ROTATE_90": "ROTATE_270", "ROTATE_270": "ROTATE_90"}


def inverse_step(method: str) -> str:
    return INVERSE.get(method, method)


def transpose(df: DataFrame, method: str, amount=100) -> DataFrame:
    """Flip or turn by quarter turns.  Below 100 the result is blended with the original,
    which is centred when the size changes."""
    x, y, swap = _steps()[method]
    w, h = (_c("height"), _c("width")) if swap else (_c("width"), _c("height"))
    turned = moved(df, x, y, w, h)
    return turned if amount >= 100 else blend_images(df, turned, amount)


def orient(df: DataFrame, orientation: Column, back: bool = False) -> DataFrame:
    """Turn each image upright by its own orientation tag, or back again."""
    steps = _steps()
    x, y, swap = _c("x"), _c("y"), F.lit(False)
    for tag, name in UPRIGHT.items():
        sx, sy, ss = steps[inverse_step(name) if back else name]
        x, y = F.when(orientation == tag, sx).otherwise(x), F.when(orientation == tag, sy).otherwise(y)
        swap = F.when(orientation == tag, F.lit(ss)).otherwise(swap)
    w = F.when(swap, _c("height")).otherwise(_c("width"))
    h = F.when(swap, _c("width")).otherwise(_c("height"))
    return moved(df, x, y, w, h)


def offset(df: DataFrame, h, v) -> DataFrame:
    """Shift with wrap-around."""
    x = F.pmod(_c("x") + as_column(h), _c("width"))
    y = F.pmod(_c("y") + as_column(v), _c("height"))
    return moved(df, x, y, _c("width"), _c("height"))


# ---- crops and copies ----

def crop_box(df: DataFrame, x0, y0, x1, y1) -> DataFrame:
    """Keep [x0, x1) x [y0, y1), limited to the image."""
    x0, y0 = F.greatest(as_column(x0), F.lit(0)), F.greatest(as_column(y0), F.lit(0))
    x1, y1 = F.least(as_column(x1), _c("width")), F.least(as_column(y1), _c("height"))
    x, y = _c("x"), _c("y")
    return moved(df.filter((x >= x0) & (x < x1) & (y >= y0) & (y < y1)), x - x0, y - y0, x1 - x0, y1 - y0)


def crop(df: DataFrame, mode="All", all=0, left=0, right=0, top=0, bottom=0) -> DataFrame:
    if mode == "Auto":
        return crop_auto(df)
    if mode == "All":
        left = right = top = bottom = all
    return crop_box(df, as_column(left), as_column(top),
                    _c("width") - as_column(right), _c("height") - as_column(bottom))


def crop_auto(df: DataFrame) -> DataFrame:
    """To the box of visible pixels; a fully transparent image stays as it is."""
    out = core.join_per_image(df, H.bounding_box(df), "left")
    whole = {"x0": F.lit(0), "y0": F.lit(0), "x1": _c("width"), "y1": _c("height")}
    return crop_box(out, *[F.coalesce(k, v) for k, v in whole.items()])


def mirror(df: DataFrame, direction="Both") -> DataFrame:
    """Symmetrical tile: the image and its reflections."""
    sx, sy = {"Both": (2, 2), "Horizontal": (2, 1), "Vertical": (1, 2)}[direction]
    x, y, w, h = _c("x"), _c("y"), _c("width"), _c("height")
    spots = [
        F.struct((x if i == 0 else 2 * w - 1 - x).alias("x"), (y if j == 0 else 2 * h - 1 - y).alias("y"))
        for i in range(sx) for j in range(sy)
    ]
    out = df.withColumn("_s", F.explode_outer(F.array(*spots)))
    return moved(out, _c("_s.x"), _c("_s.y"), w * sx, h * sy)


def grid(df: DataFrame, cols=2, rows=2, col_line=0, row_line=0, color="#FFFFFF", opacity=0, scale=False) -> DataFrame:
    """cols x rows copies with gaps of a colour."""
    if cols == 1 and rows == 1:
        return df
    df = df.withColumns({"_cl": as_column(col_line).cast("int"), "_rl": as_column(row_line).cast("int")})
    if scale:
        s = F.lit(math.sqrt(cols * rows))
        df = scale_area(df, F.floor(_c("width") / s), F.floor(_c("height") / s), ["_cl", "_rl"])
    dx, dy = _c("width") + _c("_cl"), _c("height") + _c("_rl")
    gap = lambda tx, ty: (F.pmod(tx, dx) >= _c("width")) | (F.pmod(ty, dy) >= _c("height"))
    spots = F.sequence(F.lit(0), F.lit(cols * rows - 1))
    d = core.copies_and_fill(df, dx * cols - _c("_cl"), dy * rows - _c("_rl"), spots, gap)
    alpha = F.when(_c("a").isNotNull(), F.lit(math.floor(255 * opacity / 100)))
    i, j = F.pmod(_c(core.OWN), F.lit(cols)), F.floor(_c(core.OWN) / F.lit(cols))
    return core.place_copies(d, _c("x") + i * dx, _c("y") + j * dy, core.bands(), core.solid(color, alpha))


def canvas(df: DataFrame, w, h, align_h=50, align_v=50, color="#FFFFFF", opacity=0) -> DataFrame:
    """Crop or expand without scaling.  Opacity is that of the new area (0..100) where the
    image has alpha; above 0 the image is composited on the colour."""
    w, h = as_column(w), as_column(h)
    # Offsets truncate toward zero, as int() does.
    trunc = lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("int")
    ox = trunc(as_column(align_h) * (w - _c("width")) / F.lit(100.0))
    oy = trunc(as_column(align_v) * (h - _c("height")) / F.lit(100.0))
    a = math.floor(255 * opacity / 100)
    src = df.withColumns({"_ox": ox, "_oy": oy})
    outside = lambda tx, ty: (
        (tx < _c("_ox")) | (tx >= _c("_ox") + _c("width")) | (ty < _c("_oy")) | (ty >= _c("_oy") + _c("height")))
    x, y = _c("x") + _c("_ox"), _c("y") + _c("_oy")
    inside = (x >= 0) & (x < w.cast("int")) & (y >= 0) & (y < h.cast("int"))
    one = F.when(inside, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    d = core.copies_and_fill(src, w, h, one, outside)
    own = core.bands()
    if opacity > 0:
        m = F.coalesce("a", F.lit(255))
        same = (_c("_tw") == _c("width")) & (_c("_th") == _c("height"))
        own = {c: F.when(same, _c(c)).otherwise(over(F.lit(v), _c(c), m)) for c, v in zip("rgb", rgb_of(color))}
        own["a"] = F.when(same | _c("a").isNull(), _c("a")).otherwise(over(F.lit(a), F.lit(255), m))
    return core.place_copies(d, x, y, own, core.solid(color, F.when(_c("a").isNotNull(), F.lit(a))))


# ---- resampling ----

def _cells(lo: Column, hi: Column) -> Column:
    return F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int")))


def _sized(df: DataFrame, tw, th) -> DataFrame:
    one = lambda v: F.greatest(as_column(v).cast("long"), F.lit(1))
    return df.withColumns({"_tw": one(tw), "_th": one(th)})


def scale_nearest(df: DataFrame, tw, th, keep=()) -> DataFrame:
    """Each target pixel shows the source pixel under its centre.  No shuffle."""
    d = _sized(df, tw, th)

    def span(p, size, target):
        lo = F.ceil((2 * target * p - size) / (2 * size))
        hi = F.ceil((2 * target * (p + 1) - size) / (2 * size)) - 1
        return _cells(lo, hi)

    out = d.withColumn("_x", F.explode_outer(span(_c("x"), _c("width"), _c("_tw")))).filter("_x IS NOT NULL")
    out = out.withColumn("_y", F.explode_outer(span(_c("y"), _c("height"), _c("_th")))).filter("_y IS NOT NULL")
    return moved(out, _c("_x"), _c("_y"), _c("_tw"), _c("_th"), keep)


def _weighted(d: DataFrame, total: Column, keep=()) -> DataFrame:
    """Sum of band * weight over each target pixel, divided by ``total``.  Partial sums
    are combined before the shuffle."""
    sums = d.groupBy("image_id", _c("_tw").alias("width"), _c("_th").alias("height"),
                     _c("_x").alias("x"), _c("_y").alias("y"), *keep).agg(
        *[F.sum(_c(c) * _c("_k")).alias(c) for c in RGBA], F.first(total).alias("_total"))
    return core.integers(sums.withColumns({c: F.floor(_c(c) / _c("_total")) for c in RGBA}), keep)


def _resample(df: DataFrame, tw, th, by_area: Column, keep=()) -> DataFrame:
    """Weighted sum of source pixels on each target pixel, one pass and one shuffle.
    Per image ``by_area`` picks the area average or the linear weights."""
    d = _sized(df, tw, th).withColumn("_area", by_area)
    area = _c("_area")

    def area_span(p, size, target):
        return F.floor(p * target / size), F.floor(((p + 1) * target - 1) / size)

    def area_weight(p, size, target, cell):
        return F.least((p + 1) * target, (cell + 1) * size) - F.greatest(p * target, cell * size)

    def axis(d, p, size, target, cell, weight):
        p, size, target = _c(p), _c(size), _c(target)
        (alo, ahi), (llo, lhi) = area_span(p, size, target), linear_span(p, size, target)
        d = d.withColumn(cell, F.explode_outer(_cells(F.when(area, alo).otherwise(llo), F.when(area, ahi).otherwise(lhi))))
        w = F.when(area, area_weight(p, size, target, _c(cell))).otherwise(linear_weight(p, size, target, _c(cell)))
        return d.withColumn(weight, w.cast("long")).filter(_c(weight) > 0)

    d = axis(d, "x", "width", "_tw", "_x", "_kx")
    d = axis(d, "y", "height", "_th", "_y", "_ky")
    total = F.when(area, _c("width").cast("long") * _c("height")).otherwise(4 * _c("_tw") * _c("_th"))
    return _weighted(d.withColumn("_k", _c("_kx") * _c("_ky")), total, keep)


def linear_span(p, size, target):
    """First and last target cell a source pixel has linear weight on."""
    lo = F.when(p == 0, F.lit(0)).otherwise(F.floor(((p - 1) * 2 * target + target - size) / (2 * size)))
    hi = F.when(p == size - 1, target - 1).otherwise(F.ceil(((p + 1) * 2 * target + target - size) / (2 * size)))
    return F.greatest(lo, F.lit(0)), F.least(hi, target - 1)


def linear_weight(p, size, target, cell):
    """Weight in units of 1 / (2 * target); centres beyond the edge repeat it."""
    at = F.least(F.greatest((2 * cell + 1) * size - target, F.lit(0)), 2 * target * (size - 1))
    return F.greatest(2 * target - F.abs(at - 2 * target * p), F.lit(0))


def scale_area(df: DataFrame, tw, th, keep=()) -> DataFrame:
    """Area average, the choice for making smaller."""
    return _resample(df, tw, th, F.lit(True), keep)


def scale_bilinear(df: DataFrame, tw, th, keep=()) -> DataFrame:
    """Linear between the four nearest centres, edges replicated."""
    return _resample(df, tw, th, F.lit(False), keep)


# Units of a whole weight of 1.
UNIT = 1 << 14


def cubic(x: Column) -> Column:
    """The interpolating cubic with slope -1/2, on [-2, 2], in whole units."""
    v = F.abs(x)
    inner = (F.lit(1.5) * v - F.lit(2.5)) * v * v + F.lit(1.0)
    outer = ((F.lit(-0.5) * v + F.lit(2.5)) * v - F.lit(4.0)) * v + F.lit(2.0)
    return _units(F.when(v < 1, inner).when(v < 2, outer).otherwise(F.lit(0.0)))


def windowed_sinc(x: Column) -> Column:
    """sinc(x) sinc(x / 3) on [-3, 3], in whole units."""
    t = F.lit(math.pi) * x
    lobes = F.lit(3.0) * F.sin(t) * F.sin(t / F.lit(3.0)) / (t * t)
    return _units(F.when(x == 0, F.lit(1.0)).when(F.abs(x) < 3, lobes).otherwise(F.lit(0.0)))


def _units(w: Column) -> Column:
    return F.floor(w * F.lit(float(UNIT)) + F.lit(0.5)).cast("long")


def _rounded(total: Column, weight: Column) -> Column:
    """Weighted sum to the nearest byte; NULL (no alpha band) stays."""
    v = F.floor((total + F.floor(weight / F.lit(2))) / weight)
    return F.when(total.isNotNull(), F.least(F.greatest(v, F.lit(0)), F.lit(255)).cast("int"))


def _pass(d: DataFrame, p: str, size: str, target: str, other: str, kernel, reach: int, stretch: bool, keep) -> DataFrame:
    """One direction: each pixel adds to the cells that its weight reaches; sums are combined before the shuffle."""
    P, S, T = _c(p).cast("long"), _c(size).cast("long"), _c(target).cast("long")
    # the centre of cell t lies at ((2t + 1) S - T) / 2T; the kernel is as wide as a cell where cells are larger than pixels
    unit = F.greatest(S, T) if stretch else T
    far = (F.greatest(S / T, F.lit(1.0)) if stretch else F.lit(1.0)) * F.lit(float(reach))
    lo = F.floor(((P - far) * 2 * T + T - S) / (2 * S))
    hi = F.ceil(((P + far) * 2 * T + T - S) / (2 * S))
    d = d.withColumn("_cell", F.explode_outer(_cells(F.greatest(lo, F.lit(0)).cast("long"), F.least(hi, T - 1).cast("long"))))
    x = (2 * T * P - ((2 * _c("_cell") + 1) * S - T)).cast("double") / (2 * unit)
    d = core.computed_once(d, {"_w": kernel(x)}).filter("_w <> 0")
    rest = ["image_id", "width", "height", "_tw", "_th", other, "_cell", *keep]
    sums = d.groupBy(*rest).agg(F.sum("_w").alias("_all"), *[F.sum(_c(c) * _c("_w")).alias(c) for c in RGBA])
    return sums.withColumns({c: _rounded(_c(c), _c("_all")) for c in RGBA}).withColumn(p, _c("_cell").cast("int")).drop("_cell", "_all")


def _separable(df: DataFrame, tw, th, kernel, reach: int, stretch: bool, keep=()) -> DataFrame:
    """Along lines, then along columns; a byte in between, weights that fall outside the image are left out."""
    d = _sized(df, tw, th).select("image_id", "width", "height", "_tw", "_th", "x", "y", *RGBA, *keep)
    d = _pass(d, "x", "width", "_tw", "y", kernel, reach, stretch, keep)
    d = _pass(d, "y", "height", "_th", "x", kernel, reach, stretch, keep)
    return core.integers(d.drop("width", "height").withColumnsRenamed({"_tw": "width", "_th": "height"}), keep)


def scale_bicubic(df: DataFrame, tw, th, keep=()) -> DataFrame:
    """Cubic through the four nearest pixels of each direction."""
    return _separable(df, tw, th, cubic, 2, False, keep)


def scale_antialias(df: DataFrame, tw, th, keep=()) -> DataFrame:
    """Windowed sinc of three lobes, stretched where the image gets smaller."""
    return _separable(df, tw, th, windowed_sinc, 3, True, keep)


METHODS = {"nearest": scale_nearest, "area": scale_area, "antialias": scale_antialias,
           "bilinear": scale_bilinear, "bicubic": scale_bicubic}


def resize(df: DataFrame, tw, th, method="automatic") -> DataFrame:
    """``automatic``: area where an image gets smaller both ways, else bilinear."""
    if method != "automatic":
        return METHODS[method](df, tw, th)
    smaller = (as_column(tw) < _c("width")) & (as_column(th) < _c("height"))
    return _resample(df, tw, th, smaller)


def scale(df: DataFrame, w, h, constrain=True, method="automatic", down_only=False) -> DataFrame:
    w, h = as_column(w).cast("long"), as_column(h).cast("long")
    tw, th = fit_inside(_c("width"), _c("height"), w, h) if constrain else (w, h)
    change = (_c("width") != w) | (_c("height") != h)
    if down_only:
        change = change & ((w < _c("width")) | (h < _c("height")))
    d = df.withColumns({"_sw": F.when(change, tw).otherwise(_c("width")),
                        "_sh": F.when(change, th).otherwise(_c("height"))})
    return resize(d, _c("_sw"), _c("_sh"), method)


def fit_crop(w: Column, h: Column, tw: Column, th: Column, align_h, align_v, bleed):
    """Box of the target's ratio inside the image less its bleed: x0, y0, x1, y1."""
    nearest = lambda v: F.floor(v + F.lit(0.5))
    bx = nearest(w * (as_column(bleed) / F.lit(100.0)))
    by = nearest(h * (as_column(bleed) / F.lit(100.0)))
    lw, lh = (w - 2 * bx).cast("double"), (h - 2 * by).cast("double")
    wide = lw * th > lh * tw
    cw = F.when(wide, F.greatest(nearest(lh * tw / th), F.lit(1))).otherwise(lw.cast("long"))
    ch = F.when(wide, lh.cast("long")).otherwise(F.greatest(nearest(lw * th / tw), F.lit(1)))
    x0 = bx + F.floor((lw - cw) * (as_column(align_h) / F.lit(100.0)))
    y0 = by + F.floor((lh - ch) * (as_column(align_v) / F.lit(100.0)))
    return x0, y0, x0 + cw, y0 + ch


def fit(df: DataFrame, w, h, align_h=50, align_v=50, bleed=0, method="automatic") -> DataFrame:
    """Crop to the ratio of w:h, then resize to exactly that size."""
    d = _sized(df, w, h)
    box = fit_crop(_c("width"), _c("height"), _c("_tw"), _c("_th"), align_h, align_v, bleed)
    d = d.withColumns({k: v.cast("int") for k, v in zip(("_x0", "_y0", "_x1", "_y1"), box)})
    x, y = _c("x"), _c("y")
    d = d.filter((x >= _c("_x0")) & (x < _c("_x1")) & (y >= _c("_y0")) & (y < _c("_y1")))
    d = d.withColumns({"x": x - _c("_x0"), "y": y - _c("_y0"),
                       "width": _c("_x1") - _c("_x0"), "height": _c("_y1") - _c("_y0")})
    return resize(d.drop("_x0", "_y0", "_x1", "_y1").withColumnsRenamed({"_tw": "_fw", "_th": "_fh"}),
                  _c("_fw"), _c("_fh"), method)


def thumbnail(df: DataFrame, size=128) -> DataFrame:
    """Fit in size x size, never larger than the image."""
    return scale(df, size, size, constrain=True, method="area", down_only=True)


# ---- rotation and projection ----

def _turned_size(w: Column, h: Column, c: float, s: float, expand: bool):
    if not expand:
        return w, h
    ce, se = abs(c), abs(s)
    grow = lambda a, b: F.ceil(a * F.lit(ce) + b * F.lit(se) - F.lit(1e-9))
    return grow(w, h), grow(h, w)


def rotate(df: DataFrame, angle: float, resample="nearest", expand=False, amount=100,
           color="#000000", opacity=0) -> DataFrame:
    """Counter-clockwise turn about the centre.  A source pixel lies under target centres
    at most one cell away from its own turned centre, so it checks nine cells; what is
    under no pixel is background, filled in directly."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    C, S = F.lit(c), F.lit(s)
    w, h = _c("width"), _c("height")
    tw, th = _turned_size(w, h, c, s, expand)
    # Background below full opacity needs an alpha band.
    a = F.when((F.lit(opacity) != 100) | (F.lit(color) != F.lit("#000000")), F.coalesce("a", F.lit(255))).otherwise(_c("a"))
    turned = df.withColumn("a", a)

    reach = {"nearest": 1, "bilinear": 2, "bicubic": 3}[resample]
    side = 2 * reach + 1
    near = F.sequence(F.lit(0), F.lit(side * side - 1))
    d = core.copies_and_fill(turned, tw, th, near)
    fx, fy = _c("x") + F.lit(0.5) - w / F.lit(2.0), _c("y") + F.lit(0.5) - h / F.lit(2.0)
    own = _c(core.OWN) >= 0
    cx = F.floor(C * fx + S * fy + _c("_tw") / F.lit(2.0)) + F.pmod(_c(core.OWN), F.lit(side)) - reach
    cy = F.floor(-S * fx + C * fy + _c("_th") / F.lit(2.0)) + F.floor(_c(core.OWN) / F.lit(side)) - reach
    d = core.computed_once(d, {"_x": core.either(cx, _c("_tx")).cast("int"), "_y": core.either(cy, _c("_ty")).cast("int")})
    d = d.filter((_c("_x") >= 0) & (_c("_x") < _c("_tw")) & (_c("_y") >= 0) & (_c("_y") < _c("_th")))
    if resample == "nearest":
        # Only centres within half a diagonal can show this pixel: on average 1.6 of nine.
        ex = C * fx + S * fy + _c("_tw") / F.lit(2.0) - _c("_x") - F.lit(0.5)
        ey = -S * fx + C * fy + _c("_th") / F.lit(2.0) - _c("_y") - F.lit(0.5)
        d = d.filter(~own | (ex * ex + ey * ey < F.lit(0.501)))
    # The source position under the target pixel's centre.
    dx, dy = _c("_x") + F.lit(0.5) - _c("_tw") / F.lit(2.0), _c("_y") + F.lit(0.5) - _c("_th") / F.lit(2.0)
    d = core.computed_once(d, {"_u": C * dx - S * dy + w / F.lit(2.0), "_v": S * dx + C * dy + h / F.lit(2.0)})
    u, v = _c("_u"), _c("_v")
    in_range = (u >= 0) & (u < w) & (v >= 0) & (v < h)
    back = math.floor(255 * opacity / 100)
    empty = core.solid(color, F.when(_c("a").isNotNull(), F.lit(back)))
    if resample == "nearest":
        hit = d.filter(F.when(own, (F.floor(u) == _c("x")) & (F.floor(v) == _c("y"))).otherwise(~in_range))
        out = core.place_copies(hit, _c("_x"), _c("_y"), core.bands(), empty)
    else:
        # 1/256 steps keep the weights whole; centres beyond the edge repeat it.
        def tent(pos, p, size):
            q = F.least(F.greatest(F.floor((pos - F.lit(0.5)) * F.lit(256.0)), F.lit(0)), (size - 1) * 256)
            if resample == "bicubic":
                return cubic((q - p * 256).cast("double") / F.lit(256.0))
            return F.greatest(F.lit(256) - F.abs(q - p * 256), F.lit(0))

        d = d.filter(own == in_range)
        if resample == "bicubic":
            ku, kv = tent(u, _c("x"), w), tent(v, _c("y"), h)
            part = core.computed_once(d, {"_k": core.either(ku * kv, F.lit(UNIT).cast("long"))}).filter("_k <> 0")
            part = part.withColumns({c: core.either(_c(c), empty[c]) for c in RGBA})
            sums = part.groupBy("image_id", "_tw", "_th", "_x", "_y").agg(F.sum("_k").alias("_all"), *[F.sum(_c(c) * _c("_k")).alias(c) for c in RGBA])
            out = core.integers(sums.select("image_id", _c("_tw").alias("width"), _c("_th").alias("height"), _c("_x").alias("x"), _c("_y").alias("y"), *[_rounded(_c(c), _c("_all")).alias(c) for c in RGBA]))
            return out if amount >= 100 else blend_images(df, out, amount, color, back)
        k = core.either(tent(u, _c("x"), w) * tent(v, _c("y"), h), F.lit(65536))
        part = d.withColumn("_k", k.cast("long")).filter("_k > 0")
        part = part.withColumns({c: core.either(_c(c), empty[c]) for c in RGBA})
        out = _weighted(part, F.lit(65536))
    return out if amount >= 100 else blend_images(df, out, amount, color, back)


# Scale, left and top shear angle, bottom and right factor, offsets in
# percent, and the turn that brings the preset to its side.
PERSPECTIVES = {
    "Top": (100, 30, 0, 0, 120, 0, 5, "NONE"),
    "Top Stretched": (35, -30, 0, 0, -120, 30, 5, "FLIP_TOP_BOTTOM"),
    "Bottom": (100, 30, 0, 0, 120, 0, 5, "FLIP_TOP_BOTTOM"),
    "Bottom Stretched": (35, -30, 0, 0, -120, 30, 5, "NONE"),
    "Left": (100, 0, 30, 120, 0, 5, 0, "NONE"),
    "Left Stretched": (35, 0, -30, -120, 0, 5, 30, "FLIP_LEFT_RIGHT"),
    "Right": (100, 0, 30, 120, 0, 5, 0, "FLIP_LEFT_RIGHT"),
    "Right Stretched": (35, 0, -30, -120, 0, 5, 30, "NONE"),
    "Corner Top Left": (100, 5, 5, 40, 40, 15, 5, "NONE"),
    "Corner Top Right": (100, 5, 5, 40, 40, 15, 5, "FLIP_LEFT_RIGHT"),
    "Corner Bottom Left": (100, 5, 5, 40, 40, 15, 5, "FLIP_TOP_BOTTOM"),
    "Corner Bottom Right": (100, 5, 5, 40, 40, 15, 5, "ROTATE_180"),
}


def perspective(df: DataFrame, preset="Left", color="#000000", opacity=0, auto_crop=True, user=None,
                resample="nearest") -> DataFrame:
    """Projective map by preset, or by ``user``: the eight values in the same order, the
    offsets in percent or as pixel columns.
    Magnification is unbounded here, so each target pixel looks its source pixel up by
    an equi-join on image and position."""
    zoom, left_angle, top_angle, bottom, right, off_x, off_y, turn = user or PERSPECTIVES[preset]
    pixels = lambda v, n: v if isinstance(v, Column) else F.floor(_c(n) * F.lit(v / 100.0) + F.lit(0.5))
    src = df.withColumns({"_ox": pixels(off_x, "width"), "_oy": pixels(off_y, "height")})
    x, y, swap = _steps()[inverse_step(turn)]  # presets flip or turn by 180, so sizes stay
    if swap:
        raise ValueError("a perspective cannot turn by a quarter")
    src = moved(src, x, y, _c("width"), _c("height"), ["_ox", "_oy"])
    needs_alpha = opacity != 100 or color != "#000000"
    if needs_alpha:
        src = src.withColumn("a", F.coalesce("a", F.lit(255)))
    inv = 100.0 / zoom
    sx, sy = math.tan(math.radians(-left_angle)), math.tan(math.radians(-top_angle))
    grid = core.target_grid(src, _c("width"), _c("height"), ["a", "_ox", "_oy"]).withColumn("_has", _c("a").isNotNull())
    tx, ty, w, h = _c("tx").cast("double"), _c("ty").cast("double"), _c("width"), _c("height")
    ox, oy = -_c("_ox") * F.lit(inv), -_c("_oy") * F.lit(inv)
    den = F.lit(-float(bottom)) / (h * F.lit(100.0)) * tx + F.lit(-float(right)) / (w * F.lit(100.0)) * ty + F.lit(1.0)
    u = (F.lit(inv) * tx + F.lit(sx) * ty + ox) / den
    v = (F.lit(sy) * tx + F.lit(inv) * ty + oy) / den
    # A point on or behind the horizon shows nothing.
    want = grid.withColumns({"_su": F.when(den > 0, u), "_sv": F.when(den > 0, v)})
    want = want.withColumns({"_u": F.floor("_su"), "_v": F.floor("_sv")})
    inside = (_c("_u") >= 0) & (_c("_u") < w) & (_c("_v") >= 0) & (_c("_v") < h)
    pix = src.select("image_id", _c("x").cast("long").alias("_u"), _c("y").cast("long").alias("_v"),
                     *[_c(c).alias("_" + c) for c in RGBA])
    if resample == "nearest":
        hit = want.filter(inside).join(pix, ["image_id", "_u", "_v"])
    else:
        hit = _lookup(want.filter(inside), pix, resample)
    back = math.floor(255 * opacity / 100)
    r, g, b = rgb_of(color)
    shown = hit.select("image_id", "width", "height", _c("tx").alias("x"), _c("ty").alias("y"),
                       *[_c("_" + c).alias(c) for c in RGBA])
    empty = want.filter(~F.coalesce(inside, F.lit(False))).select(
        "image_id", "width", "height", _c("tx").alias("x"), _c("ty").alias("y"),
        F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"),
        F.when(_c("_has"), F.lit(back)).alias("a"))
    out = core.integers(shown).unionByName(core.integers(empty))
    if auto_crop:
        out = crop_auto(out)
    return out if turn == "NONE" else transpose(out, turn)


def _lookup(want: DataFrame, pix: DataFrame, resample: str) -> DataFrame:
    """The source pixels around (_su, _sv), four or sixteen, weighted in 1/256 steps and summed."""
    def near(pos, size):
        return F.least(F.greatest(F.floor((pos - F.lit(0.5)) * F.lit(256.0)), F.lit(0)), (_c(size) - 1) * 256)

    d = want.withColumns({"_qu": near(_c("_su"), "width"), "_qv": near(_c("_sv"), "height")}).drop("_u", "_v", "a")
    taps = F.sequence(F.lit(-1), F.lit(2)) if resample == "bicubic" else F.sequence(F.lit(0), F.lit(1))
    d = d.withColumn("_i", F.explode_outer(taps)).withColumn("_j", F.explode_outer(taps))
    d = d.withColumns({"_u": F.floor(_c("_qu") / 256) + _c("_i"), "_v": F.floor(_c("_qv") / 256) + _c("_j")})
    if resample == "bicubic":
        weight = lambda q, p: cubic((_c(q) - _c(p) * 256).cast("double") / F.lit(256.0))
    else:
        weight = lambda q, p: F.lit(256) - F.abs(_c(q) - _c(p) * 256)
    met = core.computed_once(d, {"_k": weight("_qu", "_u") * weight("_qv", "_v")}).filter("_k <> 0").join(pix, ["image_id", "_u", "_v"])
    sums = met.groupBy("image_id", "width", "height", "tx", "ty").agg(F.sum("_k").alias("_all"), *[F.sum(_c("_" + c) * _c("_k")).alias("_" + c) for c in RGBA])
    value = lambda c: _rounded(_c("_" + c), _c("_all")) if resample == "bicubic" else F.floor(_c("_" + c) / F.lit(65536))
    return sums.withColumns({"_" + c: value(c) for c in RGBA})


# ---- blending of two whole images ----

def blend_images(first: DataFrame, second: DataFrame, amount, color="#000000", alpha=0) -> DataFrame:
    """Blend image by image at ``amount`` percent toward ``second``.  A first image of
    another size is centred on it, the rest being ``color``.  The key is the pixel."""
    corner = (F.col("x") == 0) & (F.col("y") == 0)  # one row per image
    target = second.filter(corner).select("image_id", _c("width").alias("_tw"), _c("height").alias("_th"))
    sizes = first.filter(corner).select("image_id", "width", "height").join(target, "image_id")
    tagged = core.join_per_image(first.select(*core.COLUMNS), sizes)
    ox = F.floor((_c("_tw") - _c("width")) / F.lit(2))
    oy = F.floor((_c("_th") - _c("height")) / F.lit(2))
    placed = tagged.select("image_id", (_c("x") + ox).cast("int").alias("x"), (_c("y") + oy).cast("int").alias("y"),
                           *[_c(c).alias("_" + c) for c in RGBA])
    out = second.join(placed, ["image_id", "x", "y"], "left")
    start = dict(zip("rgb", rgb_of(color)))
    new = {c: blend(F.coalesce("_" + c, F.lit(v)), _c(c), amount) for c, v in start.items()}
    new["a"] = F.when(_c("a").isNotNull(), blend(
        F.when(_c("_r").isNull(), F.lit(alpha)).otherwise(F.coalesce("_a", F.lit(255))), _c("a"), amount))
    return core.integers(out.withColumns(new))
