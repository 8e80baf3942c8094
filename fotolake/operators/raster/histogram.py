"""Histograms, image statistics, and the operators they drive.

Counts are partially aggregated before the shuffle and an image has at most 256 values
per band, so histogram windows are bounded whatever the image size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ...functions.pixels import RGB, blend, floor_byte, luma
from . import core

IMAGE = ("image_id", "width", "height")


def _bands(df: DataFrame, bands=RGB) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("band"), F.col(c).alias("value")) for c in bands])
    return df.select(*IMAGE, F.explode_outer(pairs).alias("_p")).select(*IMAGE, "_p.band", "_p.value")


def histogram(df: DataFrame, bands=RGB) -> DataFrame:
    """image_id, width, height, band, value, n."""
    return (
        _bands(df, bands).filter(F.col("value").isNotNull())
        .groupBy(*IMAGE, "band", "value").agg(F.count("*").alias("n"))
    )


def luma_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(*IMAGE, luma().alias("value")).agg(F.count("*").alias("n"))


def image_statistics(df: DataFrame) -> DataFrame:
    """Per image: pixel count, exact sum of each band, extrema of luma."""
    return df.groupBy(*IMAGE).agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias("sum_" + c) for c in RGB],
        F.min(luma()).alias("min_luma"), F.max(luma()).alias("max_luma"),
    )


def mean_tone(df: DataFrame) -> DataFrame:
    return df.groupBy("image_id").agg(*[(F.sum(c).cast("double") / F.count("*")).alias(c) for c in RGB])


def bounding_box(df: DataFrame) -> DataFrame:
    """Box of pixels with alpha above 0, end exclusive; an image without alpha is whole."""
    return (
        df.filter(F.coalesce("a", F.lit(255)) > 0)
        .groupBy(*IMAGE)
        .agg(F.min("x").alias("x0"), F.min("y").alias("y0"),
             (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    )


def used_colors(df: DataFrame) -> DataFrame:
    """Distinct colours of each image with their pixel counts."""
    return df.groupBy("image_id", *RGB).agg(F.count("*").alias("n"))


def unused_values(df: DataFrame, band: str) -> DataFrame:
    """Values of 0..255 a band never takes, per image.  The 256 candidates come from the
    image's own set, so no grid of images and values is built and joined."""
    used = df.groupBy("image_id").agg(F.collect_set(band).alias("used"))  # at most 256 entries
    every = F.sequence(F.lit(0), F.lit(255))
    return used.select("image_id", F.explode(F.array_except(every, F.col("used"))).alias("value"))


def cutoff_extrema(df: DataFrame, cutoff=0) -> DataFrame:
    """Per image and band lowest and highest value left after dropping ``cutoff`` percent
    of the pixels at each end."""
    w = Window.partitionBy("image_id", "band").orderBy("value")
    h = histogram(df)
    total = F.sum("n").over(Window.partitionBy("image_id", "band"))
    below = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    cut = F.floor(F.col("total") * F.lit(float(cutoff)) / F.lit(100.0))
    return (
        h.withColumns({"total": total, "below": below})
        .filter((F.col("below") > cut) & (F.col("total") - F.col("below") + F.col("n") > cut))
        .groupBy(*IMAGE, "band")
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    )


def autocontrast(df: DataFrame, cutoff=0, amount=100) -> DataFrame:
    wide = cutoff_extrema(df, cutoff).groupBy(*IMAGE).agg(
        *[F.max(F.when(F.col("band") == c, F.col(k))).alias(f"_{k}_{c}") for c in RGB for k in ("lo", "hi")])
    out = core.join_per_image(df, wide, "left")

    def stretch(c):
        lo, hi = F.col("_lo_" + c), F.col("_hi_" + c)
        v = F.when(hi > lo, floor_byte((F.col(c) - lo) * F.lit(255.0) / (hi - lo))).otherwise(F.col(c))
        return blend(F.col(c), v, amount)

    return out.withColumns({c: stretch(c) for c in RGB}).select(*core.COLUMNS)


def equalize_table(df: DataFrame) -> DataFrame:
    """Per image one lookup array of 256 entries for each band.  A value's entry is repeated
    up to the next value that occurs, so the array is built in one walk."""
    key = Window.partitionBy("image_id", "band")
    by_value = key.orderBy("value")
    upto = by_value.rowsBetween(Window.unboundedPreceding, 0)
    h = histogram(df).withColumns({
        "cdf": F.sum("n").over(upto), "total": F.sum("n").over(key), "next": F.lead("value", 1, 256).over(by_value)})
    h = h.withColumn("first", F.min("cdf").over(key))
    span = F.col("total") - F.col("first")
    new = F.when(span > 0, F.floor(F.lit(255.0) * (F.col("cdf") - F.col("first")) / span)).otherwise(F.col("value"))
    entry = F.struct("value", new.cast("int").alias("new"), (F.col("next") - F.col("value")).alias("run"))
    # At most 256 entries per band.
    one = h.groupBy(*IMAGE).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("band") == c, entry))).alias("_e_" + c) for c in RGB])

    def lookup(c):
        before = F.array_repeat(F.lit(0), F.col("_e_" + c)[0]["value"])
        return F.concat(before, F.flatten(F.transform("_e_" + c, lambda e: F.array_repeat(e["new"], e["run"]))))

    return one.select(*IMAGE, *[lookup(c).alias("_lut_" + c) for c in RGB])


def equalize(df: DataFrame, amount=100) -> DataFrame:
    table = equalize_table(df)
    out = core.join_per_image(df, table, "left")
    new = {c: blend(F.col(c), F.get("_lut_" + c, F.col(c)), amount) for c in RGB}
    return out.withColumns(new).select(*core.COLUMNS)
