"""Tone and colour operators: one projection each, no shuffle, alpha kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.pixels import RGB, blend, clamp, floor_byte, luma, rgb_of, scale_by
from . import core


def _toward(df: DataFrame, values, amount) -> DataFrame:
    """Blend the colour bands toward ``values`` (one column per band)."""
    return df.withColumns({c: blend(F.col(c), v, amount) for c, v in zip(RGB, values)})


def invert(df: DataFrame, amount=100) -> DataFrame:
    return _toward(df, [255 - F.col(c) for c in RGB], amount)


def brightness(df: DataFrame, amount=50) -> DataFrame:
    """Toward black below zero, toward white above."""
    if amount == 0:
        return df
    return _toward(df, [F.lit(0 if amount < 0 else 255)] * 3, abs(amount))


def contrast(df: DataFrame, amount=50) -> DataFrame:
    """Toward the image's mean luma below zero, toward pure bands above."""
    if amount == 0:
        return df
    if amount > 0:
        return _toward(df, [F.when(F.col(c) > 128, 255).otherwise(0) for c in RGB], amount)
    mean = df.groupBy("image_id", "width", "height").agg(
        F.floor(F.sum(luma()).cast("double") / F.count("*")).cast("int").alias("_mean"))
    out = core.join_per_image(df, mean)
    return _toward(out, [F.col("_mean")] * 3, -amount).drop("_mean")


def saturation(df: DataFrame, amount=-100) -> DataFrame:
    """Toward luma below zero; above, away from it."""
    if amount == 0:
        return df
    grey = luma()
    if amount < 0:
        values = [grey] * 3
    else:
        part = F.floor(grey * F.lit(0.7)).cast("int")
        values = [floor_byte(F.greatest(F.col(c) - part, F.lit(0)) / F.lit(0.3)) for c in RGB]
    return _toward(df, values, abs(amount))


def desaturate(df: DataFrame, amount=100) -> DataFrame:
    return _toward(df, [luma()] * 3, amount)


def solarize(df: DataFrame, threshold=128, amount=100) -> DataFrame:
    return _toward(df, [F.when(F.col(c) < threshold, F.col(c)).otherwise(255 - F.col(c)) for c in RGB], amount)


def posterize(df: DataFrame, bits=1, amount=100) -> DataFrame:
    mask = 255 & ~(2 ** (8 - bits) - 1)
    return _toward(df, [F.col(c).bitwiseAND(mask) for c in RGB], amount)


def colorize(df: DataFrame, black="#735710", white="#FFFFFF", amount=100) -> DataFrame:
    """Luma mapped on the line between two colours."""
    line = [
        floor_byte(F.lit(lo) + luma() * F.lit(hi - lo) / F.lit(255.0)) for lo, hi in zip(rgb_of(black), rgb_of(white))
    ]
    return _toward(df, line, amount)


def warm_up(df: DataFrame, midtone="#805d40", brighten=50, amount=50) -> DataFrame:
    """Bend luma through ``midtone``, keeping black and white."""
    i = luma()
    curve = [
        floor_byte(F.lit(4.0 * (m / 255.0 - 0.5 + brighten / 600.0) / 255.0) * (255 - i) * i + i)
        for m in rgb_of(midtone)
    ]
    return _toward(df, curve, amount)


CORNERS = {
    "Top Left": (False, False), "Top Right": (True, False),
    "Bottom Left": (False, True), "Bottom Right": (True, True),
}


def color_to_alpha(df: DataFrame, select="Value", color="#FFFFFF") -> DataFrame:
    """Make a colour transparent: the given one or that of a corner pixel."""
    alpha = F.coalesce("a", F.lit(255))
    if select == "Value":
        out = df.withColumns({"_c" + c: F.lit(v) for c, v in zip(RGB, rgb_of(color))}).withColumn("_ca", F.lit(255))
    else:
        right, bottom = CORNERS[select]
        at_x = F.col("x") == (F.col("width") - 1 if right else F.lit(0))
        at_y = F.col("y") == (F.col("height") - 1 if bottom else F.lit(0))
        corner = df.filter(at_x & at_y).select(
            "image_id", "width", "height", *[F.col(c).alias("_c" + c) for c in RGB], alpha.alias("_ca"))
        out = core.join_per_image(df, corner)

    def share(c: str) -> Column:
        v, k = F.col(c).cast("double"), F.col("_c" + c)
        up = F.when(k < 255, (v - k) / (F.lit(255.0) - k)).otherwise(F.lit(0.0))
        down = F.when(k > 0, (k - v) / k.cast("double")).otherwise(F.lit(0.0))
        return F.greatest(up, down)

    out = out.withColumn("_t", F.greatest(*[share(c) for c in RGB]))
    on = F.col("_ca") > 0
    unmix = {
        c: F.when(on & (F.col("_t") > 0), floor_byte((F.col(c) - F.col("_c" + c)) / F.col("_t") + F.col("_c" + c)))
        .otherwise(F.col(c)) for c in RGB
    }
    unmix["a"] = F.when(on, floor_byte(alpha * F.col("_t"))).otherwise(alpha)
    return out.withColumns(unmix).drop("_t", "_ca", *["_c" + c for c in RGB])


def convert_mode(df: DataFrame, mode: str) -> DataFrame:
    """``1``, ``L``, ``LA``, ``RGB``, ``RGBA`` keep the pixel columns; ``P`` has the colours of
    a palette of 256; ``CMYK`` and ``YCbCr`` give their own bands."""
    if mode == "P":
        from .palette import quantized

        return quantized(df).drop("p")
    none = F.lit(None).cast("int")
    grey = luma()
    if mode == "1":
        return df.withColumns({**{c: F.when(grey >= 128, 255).otherwise(0) for c in RGB}, "a": none})
    if mode in ("L", "LA"):
        a = none if mode == "L" else F.coalesce("a", F.lit(255))
        return df.withColumns({**{c: grey for c in RGB}, "a": a})
    if mode == "RGB":
        return df.withColumn("a", none)
    if mode == "RGBA":
        return df.withColumn("a", F.coalesce("a", F.lit(255)))
    r, g, b = (F.col(c) for c in RGB)
    if mode == "CMYK":
        bands = {"c": 255 - r, "m": 255 - g, "ye": 255 - b, "k": F.lit(0)}
    elif mode == "YCbCr":
        bands = {
            "yl": grey,
            "cb": floor_byte(128.0 - 0.168736 * r - 0.331264 * g + 0.5 * b),
            "cr": floor_byte(128.0 + 0.5 * r - 0.418688 * g - 0.081312 * b),
        }
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.select(*core.SHAPE, *[v.cast("int").alias(k) for k, v in bands.items()])


def as_shown(df: DataFrame, mode: str) -> DataFrame:
    """Pixels as an image in this mode shows them: bands of CMYK and YCbCr are turned back into colours."""
    if mode not in ("CMYK", "YCbCr"):
        return convert_mode(df, mode)
    d = convert_mode(df, mode)
    if mode == "CMYK":
        back = {c: 255 - F.col(k) for c, k in zip(RGB, ("c", "m", "ye"))}
    else:
        y, cb, cr = F.col("yl"), F.col("cb") - 128, F.col("cr") - 128
        back = {"r": floor_byte(y + F.lit(1.402) * cr + F.lit(0.5)), "b": floor_byte(y + F.lit(1.772) * cb + F.lit(0.5)),
                "g": floor_byte(y - F.lit(0.344136) * cb - F.lit(0.714136) * cr + F.lit(0.5))}
    return d.select(*core.SHAPE, *[back[c].cast("int").alias(c) for c in RGB], F.lit(None).cast("int").alias("a"))


# ---- alpha helpers ----

def has_alpha() -> Column:
    return F.col("a").isNotNull()


def alpha() -> Column:
    return F.coalesce("a", F.lit(255))


def put_alpha(df: DataFrame, value: Column) -> DataFrame:
    return df.withColumn("a", clamp(value))


def remove_alpha(df: DataFrame) -> DataFrame:
    return df.withColumn("a", F.lit(None).cast("int"))


def reduce_opacity(df: DataFrame, opacity=100) -> DataFrame:
    """Scale alpha by a percentage; an image without alpha becomes translucent."""
    return df.withColumn("a", scale_by(alpha(), opacity))


def transparent_images(df: DataFrame) -> DataFrame:
    """image_id and whether any pixel shows what is below it; one partial row per task."""
    return df.groupBy("image_id").agg(F.coalesce(F.min("a") < 255, F.lit(False)).alias("transparent"))
