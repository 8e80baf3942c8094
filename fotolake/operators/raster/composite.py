"""Compositing: stamps, masks, backgrounds, borders, contours, corners, shadows, reflections."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.pixels import RGB, RGBA, as_column, floor_byte, luma, over, rgb_of, scale_by
from ...functions.units import length_px, place
from ...session import broadcast_within
from . import core, geometry as G, neighbourhood as N

# A stamp of up to 2048 x 2048 pixels is broadcast; a larger one joins by shuffle.
STAMP_PIXELS = 1 << 22


@dataclass
class Stamp:
    """One image laid on every other: watermark, mask, highlight or background."""

    pixels: DataFrame
    width: int
    height: int

    @classmethod
    def of(cls, pixels: DataFrame, turn: str | None = None) -> "Stamp":
        if turn and turn != "NONE":
            pixels = G.transpose(pixels.withColumn("image_id", F.lit(0)), turn)
        size = pixels.select("width", "height").first()
        return cls(pixels, size["width"], size["height"])

    def laid(self, df: DataFrame, mx: Column, my: Column) -> DataFrame:
        """Adds the stamp's m_r, m_g, m_b, m_a at stamp position (mx, my); NULL outside."""
        side = self.pixels.select(
            F.col("x").alias("_mx"), F.col("y").alias("_my"),
            *[F.col(c).alias("m_" + c) for c in RGB], F.coalesce("a", F.lit(255)).alias("m_a"))
        big = df.withColumns({"_mx": mx.cast("int"), "_my": my.cast("int")})
        return big.join(broadcast_within(side, STAMP_PIXELS), ["_mx", "_my"], "left").drop("_mx", "_my")

    def stretched(self, df: DataFrame) -> DataFrame:
        """Stamp sampled over the whole image."""
        at = lambda p, n, m: F.floor((2 * F.col(p).cast("long") + 1) * m / (2 * F.col(n)))
        return self.laid(df, at("x", "width", self.width), at("y", "height", self.height))

    def layer(self, df: DataFrame, method="Scale", h="50%", v="50%", hj="Middle", vj="Middle", opacity=100):
        """Stamp as a layer: ``Tile``, ``Scale`` (ratio kept, centred) or ``By Offset``."""
        x, y, w, hgt = (F.col(c) for c in ("x", "y", "width", "height"))
        if method == "Tile":
            out = self.laid(df, F.pmod(x, F.lit(self.width)), F.pmod(y, F.lit(self.height)))
        elif method == "Scale":
            ratio = F.least(w / F.lit(float(self.width)), hgt / F.lit(float(self.height)))
            sw, sh = F.floor(self.width * ratio), F.floor(self.height * ratio)
            px, py = x - F.floor((w - sw) / F.lit(2)), y - F.floor((hgt - sh) / F.lit(2))
            inside = (px >= 0) & (px < sw) & (py >= 0) & (py < sh)
            mx = F.when(inside, F.floor((2 * px + 1) * self.width / (2 * sw)))
            my = F.when(inside, F.floor((2 * py + 1) * self.height / (2 * sh)))
            out = self.laid(df, mx, my)
        elif method == "By Offset":
            ox = place(length_px(h, w) if isinstance(h, str) else h, hj, w, self.width)
            oy = place(length_px(v, hgt) if isinstance(v, str) else v, vj, hgt, self.height)
            out = self.laid(df, x - ox, y - oy)
        else:
            raise ValueError(f"unknown method {method!r}")
        none = {"m_" + c: F.coalesce("m_" + c, F.lit(0)) for c in RGB}
        return out.withColumns({**none, "m_a": scale_by(F.coalesce("m_a", F.lit(0)), opacity)})


def _drop_layer(df: DataFrame) -> DataFrame:
    return df.select(*core.COLUMNS)


def paste(dst: dict[str, Column], src: dict[str, Column], mask: Column, same_size: bool) -> dict[str, Column]:
    """Paste ``src`` on ``dst`` through its own alpha.  On a destination with alpha of the
    same size, what was transparent there takes the source's colour."""
    out = {c: over(dst[c], src[c], mask) for c in RGB}
    if dst.get("a") is None:
        return out
    if same_size:
        out = {c: over(out[c], src[c], 255 - dst["a"]) for c in RGB}
    out["a"] = over(dst["a"], F.lit(255), mask)
    return out


def watermark(df: DataFrame, stamp: Stamp, method="Scale", opacity=100, **where) -> DataFrame:
    out = stamp.layer(df, method, opacity=opacity, **where)
    return _drop_layer(out.withColumns({c: over(F.col(c), F.col("m_" + c), F.col("m_a")) for c in RGBA}))


def background(df: DataFrame, color="#FFFFFF", opacity=100, stamp: Stamp | None = None, method="Scale", **where):
    """Fill under transparency with a colour or an image; opaque images stay as they are."""
    seen = F.col("a").isNotNull()
    src = {c: F.col(c) for c in RGB}
    if stamp is None:
        a = math.floor(255 * opacity / 100)
        dst = {c: F.lit(v) for c, v in zip(RGB, rgb_of(color))}
        dst["a"] = None if a == 255 else F.lit(a)
        out = df
    else:
        out = stamp.layer(df, method, opacity=opacity, **where)
        dst = {c: F.col("m_" + c) for c in RGBA}
    new = paste(dst, src, F.col("a"), same_size=True)
    new.setdefault("a", F.lit(None).cast("int"))
    return _drop_layer(out.withColumns({c: F.when(seen, v).otherwise(F.col(c)) for c, v in new.items()}))


def mask(df: DataFrame, stamp: Stamp) -> DataFrame:
    """Alpha becomes the smaller of alpha and the mask's luma."""
    out = stamp.stretched(df)
    return _drop_layer(out.withColumn("a", F.least(F.coalesce("a", F.lit(255)), luma("m_r", "m_g", "m_b"))))


def highlight(df: DataFrame, stamp: Stamp, opacity=100) -> DataFrame:
    """Overlay the stamp, limited to where the image itself shows."""
    out = stamp.stretched(df)
    o = math.floor(255 * opacity / 100)
    m = F.col("m_a") if opacity >= 100 else floor_byte(F.col("m_a") * o / F.lit(255.0))
    out = out.withColumn("_m", F.least(m, F.coalesce("a", F.lit(255))))
    new = {c: over(F.col(c), F.col("m_" + c), F.col("_m")) for c in RGB}
    new["a"] = over(F.coalesce("a", F.lit(255)), F.lit(255), F.col("_m"))
    return _drop_layer(out.withColumns(new))


def border(df: DataFrame, width=1, left=None, right=None, top=None, bottom=None, color="#000000", opacity=100):
    """Frame of a colour.  Positive widths add pixels outside; negative ones tint the
    edge inside at ``opacity``."""
    sides = {k: as_column(width if v is None else v).cast("int")
             for k, v in (("_l", left), ("_r", right), ("_t", top), ("_b", bottom))}
    d = df.withColumns(sides)
    out = {k: F.greatest(F.col(k), F.lit(0)) for k in sides}
    inn = {k: -F.least(F.col(k), F.lit(0)) for k in sides}
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    edge = (x < inn["_l"]) | (x >= w - inn["_r"]) | (y < inn["_t"]) | (y >= h - inn["_b"])
    keep = int(255 - opacity / 100.0 * 255)
    tint = {c: F.when(edge, over(v, F.col(c), F.lit(keep))).otherwise(F.col(c))
            for c, v in core.solid(color, 255).items()}
    outside = lambda tx, ty: (
        (tx < out["_l"]) | (tx >= out["_l"] + w) | (ty < out["_t"]) | (ty >= out["_t"] + h))
    d = core.copies_and_fill(d, w + out["_l"] + out["_r"], h + out["_t"] + out["_b"], F.array(F.lit(0)), outside)
    frame = core.solid(color, F.when(F.col("a").isNotNull(), F.lit(255)))
    return core.place_copies(d, x + out["_l"], y + out["_t"], tint, frame)


def contour(df: DataFrame, size=1, offset=0, color="#000000", fill="#FFFFFF", opacity=100, include_image=True):
    """Outline of the visible shape; an opaque image is a shape without holes.

    A source pixel knows where it adds to the enlarged outer shape, to the inner shape
    and to the image, so the three are summed on the target in one grouping."""
    d = df.withColumns({"_s": as_column(size).cast("long"), "_o": as_column(offset).cast("long"),
                        "_m": F.coalesce("a", F.lit(255)), "_has": F.col("a").isNotNull()})
    s, e = F.col("_s"), F.col("_s") + F.col("_o")
    w, h = F.col("width"), F.col("height")
    d = d.withColumn("_part", F.explode_outer(F.array(F.lit(0), F.lit(1), F.lit(2))))  # outer, inner, image
    part = F.col("_part")
    grow = F.when(part == 0, 2 * e).otherwise(2 * F.col("_o"))
    d = d.withColumns({"_tw": w + grow, "_th": h + grow})

    def axis(d, p, size, target, cell, weight):
        p, size, target = F.col(p), F.col(size), F.col(target)
        lo, hi = G.linear_span(p, size, target)
        span = F.when(part < 2, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array(p))
        d = d.withColumn(cell, F.explode_outer(span))
        k = F.when(part < 2, G.linear_weight(p, size, target, F.col(cell))).otherwise(F.lit(1))
        return d.withColumn(weight, k.cast("long")).filter(F.col(weight) > 0)

    d = axis(axis(d, "x", "width", "_tw", "_x", "_kx"), "y", "height", "_th", "_y", "_ky")
    # Inner and image are moved to their place in the outer frame.
    shift = F.when(part == 0, F.lit(0)).when(part == 1, s).otherwise(e)
    sums = lambda n: F.sum(F.when(part == n, F.col("_m") * F.col("_kx") * F.col("_ky")))
    whole = lambda n: F.max(F.when(part == n, 4 * F.col("_tw") * F.col("_th")))
    one = d.groupBy(
        "image_id", (w + 2 * e).alias("width"), (h + 2 * e).alias("height"),
        (F.col("_x") + shift).alias("x"), (F.col("_y") + shift).alias("y"), "_has",
    ).agg(
        F.floor(sums(0) / whole(0)).alias("outer"), F.coalesce(F.floor(sums(1) / whole(1)), F.lit(0)).alias("inner"),
        F.coalesce(F.max(F.when(part == 2, F.col("_m"))), F.lit(0)).alias("image"),
        *[F.coalesce(F.max(F.when(part == 2, F.col(c))), F.lit(0)).alias("p" + c) for c in RGB],
    )
    om = over(F.col("outer"), F.lit(math.floor(255 * opacity / 100)), F.col("inner"))
    if include_image:
        om = over(om, F.lit(255), F.col("image"))
    one = one.withColumn("om", om)
    new = {}
    for c, line, body in zip(RGB, rgb_of(color), rgb_of(fill)):
        v = floor_byte(F.lit(255) + F.col("om") * F.lit(line - 255) / F.lit(255.0))
        v = over(v, F.lit(body), F.col("inner"))
        new[c] = over(v, F.col("p" + c), F.col("image")) if include_image else v
    keep_alpha = F.col("_has") if opacity >= 100 else F.lit(True)
    return core.integers(one.withColumns({**new, "a": F.when(keep_alpha, F.col("om"))}))


def round_corners(df: DataFrame, radius, method="Rounded", corners=None, opacity=100, color="#FFFFFF") -> DataFrame:
    """Alpha of a rounded, square or crossed frame.  ``corners`` names the four methods
    top left, top right, bottom left, bottom right."""
    kinds = corners or (method,) * 4
    r = as_column(radius).cast("int")
    o = int(opacity / 100.0 * 255)
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    left, right, top, bottom = x < r, x >= w - r, y < r, y >= h - r
    # Twice the distance from the corner circle's centre to the pixel's centre.
    dx = F.when(left, 2 * (r - x) - 1).otherwise(2 * (x - (w - r)) + 1)
    dy = F.when(top, 2 * (r - y) - 1).otherwise(2 * (y - (h - r)) + 1)
    values = {"Rounded": F.when(dx * dx + dy * dy <= 4 * r * r, o).otherwise(0),
              "Square": F.lit(255), "Cross": F.lit(0)}
    m = F.lit(o)
    places = [top & left, top & right, bottom & left, bottom & right]
    for at, kind in reversed(list(zip(places, kinds))):
        m = F.when(at, values[kind]).otherwise(m)
    out = df.withColumn("_m", m)
    new = {c: over(F.col(c), F.lit(v), 255 - F.col("_m")) for c, v in zip(RGB, rgb_of(color))}
    return _drop_layer(out.withColumns(new).withColumn("a", F.col("_m")))


def shadow(df: DataFrame, h=5, v=5, border=8, blur=3, back="#FFFFFF", color="#444444", force_back=True) -> DataFrame:
    """Blurred silhouette under the image on a larger canvas."""
    hx, vy, b = (as_column(c).cast("int") for c in (h, v, border))
    d = df.withColumns({"_hx": hx, "_vy": vy, "_b": b, "_has": F.col("a").isNotNull()})
    hx, vy, b = F.col("_hx"), F.col("_vy"), F.col("_b")
    w, hgt = F.col("width"), F.col("height")
    tw, th = w + F.abs(hx) + 2 * b, hgt + F.abs(vy) + 2 * b
    zero = F.lit(0)
    sx, sy = b + F.greatest(hx, zero), b + F.greatest(vy, zero)
    ix, iy = b - F.least(hx, zero), b - F.least(vy, zero)
    m = F.coalesce("a", F.lit(255))
    within = lambda tx, ty, x0, y0: (tx >= x0) & (tx < x0 + w) & (ty >= y0) & (ty < y0 + hgt)
    rest = lambda tx, ty: ~within(tx, ty, sx, sy) & ~within(tx, ty, ix, iy)
    d = core.copies_and_fill(d, tw, th, F.array(F.lit(0), F.lit(1)), rest)  # 0 shade, 1 image
    copy = F.col(core.OWN)
    at = lambda p, s, i, t: F.when(copy == 0, F.col(p) + s).when(copy == 1, F.col(p) + i).otherwise(F.col(t))
    one = d.groupBy(
        "image_id", F.col("_tw").alias("width"), F.col("_th").alias("height"),
        at("x", sx, ix, "_tx").alias("x"), at("y", sy, iy, "_ty").alias("y"), "_has",
    ).agg(
        F.coalesce(F.max(F.when(copy == 0, m)), zero).alias("s"),
        *[F.max(F.when(copy == 1, F.col(c))).alias("p" + c) for c in RGB], F.max(F.when(copy == 1, m)).alias("pa"),
    )
    # The blur runs on band a; the image waits in extra columns.
    stage = one.withColumns({"a": F.col("s"), **{c: F.lit(0) for c in RGB}})
    blurred = N.filtered(stage, N.kernel_filter("blur", ("a",)), ("a",), blur,
                         extra=("_has", "pr", "pg", "pb", "pa"))
    image_m = F.coalesce("pa", zero)
    has = F.col("_has")
    alpha = over(F.col("a"), F.lit(255), image_m)
    out = blurred.withColumn("_alpha", alpha)
    new = {}
    for c, sc, bg in zip(RGB, rgb_of(color), rgb_of(back)):
        p = F.coalesce("p" + c, zero)
        clear = over(F.lit(sc), p, image_m)
        if force_back:
            clear = over(clear, F.lit(bg), 255 - F.col("_alpha"))
        solid = over(over(F.lit(bg), F.lit(sc), F.col("a")), p, image_m)
        new[c] = F.when(has, clear).otherwise(solid)
    return core.integers(out.withColumns(new).withColumn("a", F.when(has, F.col("_alpha"))))


def reflection(df: DataFrame, depth, gap=0, opacity=60, color="#FFFFFF", back_opacity=90,
               blur=False, scale=False, method="area") -> DataFrame:
    """Fading mirror image below.  Without blur or scaling nothing is shuffled."""
    o, bo = math.floor(255 * opacity / 100), math.floor(255 * back_opacity / 100)
    base = core.solid(color, None if bo == 255 else bo)
    w, hgt = F.col("width"), F.col("height")
    d = df.withColumns({"_d": F.least(hgt, as_column(depth).cast("int")), "_g": as_column(gap).cast("int"), "_h": hgt})
    has = F.col("a").isNotNull()
    dst = {**base, "a": None if bo == 255 else F.lit(bo)}
    src = {c: F.col(c) for c in RGB}
    m = F.coalesce("a", F.lit(255))
    th = hgt + F.col("_g") + F.col("_d")

    top = paste(dst, src, m, same_size=False)
    top.setdefault("a", F.lit(None).cast("int"))
    if bo > 0:
        under = paste(dst, src, m, same_size=True)
        face = {**{c: F.when(has, under[c]).otherwise(F.col(c)) for c in RGB},
                "a": F.when(has, under.get("a", F.lit(255))).otherwise(F.lit(255))}
    else:
        face = {**src, "a": m}

    def faded(values, k):
        """A reflected pixel of line k below the gap, on the background."""
        f = F.floor(F.lit(float(o)) * (F.col("_d") - k) / F.col("_d")).cast("int")
        out = {c: over(base[c], values[c], f) for c in RGB}
        out["a"] = F.lit(None).cast("int") if bo == 255 else over(F.lit(bo), values["a"], f)
        return out

    x, y = F.col("x"), F.col("y")
    gap_line = lambda tx, ty: (ty >= hgt) & (ty < hgt + F.col("_g"))
    if not (scale or blur):
        k = hgt - 1 - y
        copies = F.when(k < F.col("_d"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        d = core.copies_and_fill(d, w, th, copies, gap_line)
        low, second = faded(face, k), F.col(core.OWN) == 1
        own = {c: F.when(second, low[c]).otherwise(top[c]) for c in RGBA}
        return core.place_copies(d, x, F.when(second, hgt + F.col("_g") + k).otherwise(y), own, base)
    upper = core.place_copies(core.copies_and_fill(d, w, th, F.array(F.lit(0)), gap_line), x, y, top, base)
    flipped = d.withColumns(face).withColumn("y", hgt - 1 - y)
    facts = ["_d", "_g", "_h"]
    if scale:
        plain = G.METHODS[method](flipped, w, F.col("_d"), facts)
    else:
        plain = G.moved(flipped.filter(y < F.col("_d")), x, y, w, F.col("_d"), facts)
    lower = N.effect(plain, "blur", extra=facts) if blur else plain
    lower = lower.withColumns(faded(core.bands(), y))
    lower = G.moved(lower, x, y + F.col("_h") + F.col("_g"), w, F.col("_h") + F.col("_g") + F.col("_d"))
    return upper.unionByName(lower)


def checkerboard(df: DataFrame, size=8, light="#FFFFFF", dark="#CCCCCC") -> DataFrame:
    """Squares under transparent pixels; the result is opaque."""
    odd = F.pmod(F.floor(F.col("x") / size) + F.floor(F.col("y") / size), F.lit(2)) == 1
    m = F.coalesce("a", F.lit(255))
    new = {c: over(F.when(odd, dk).otherwise(lt), F.col(c), m)
           for c, lt, dk in zip(RGB, rgb_of(light), rgb_of(dark))}
    return df.withColumns(new).withColumn("a", F.lit(None).cast("int"))
