"""Decoded images: verification and pixels from Spark's image source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.paths import strip_file_scheme
from ..operators.raster import strips


def read_images(spark: SparkSession, paths, keep_invalid: bool = True) -> DataFrame:
    """path and the image struct; an unreadable file stays as a row of size -1."""
    return (
        spark.read.format("image").option("dropInvalid", str(not keep_invalid).lower())
        .option("recursiveFileLookup", "true").load(paths)
        .select(strip_file_scheme(F.col("image.origin")).alias("path"), "image.*")
    )


def verify(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) paths with their sizes."""
    cols = images.select("path", "width", "height", F.col("nChannels").alias("bands"))
    return cols.filter(F.col("width") > 0), cols.filter(F.col("width") <= 0)


def mode_name(bands: Column) -> Column:
    """Mode by number of bands."""
    return F.element_at(F.array(*[F.lit(m) for m in ("L", "LA", "RGB", "RGBA")]), bands)


def read_strips(images: DataFrame) -> DataFrame:
    """path and packed strips (bytes by line, pixel and band; colours red first, grey as three bands)."""
    return strips.from_images(images).withColumnRenamed("image_id", "path")


def read_pixels(images: DataFrame) -> DataFrame:
    """path, width, height, x, y, r, g, b, a; a is NULL without an alpha band."""
    return strips.to_pixels(strips.from_images(images)).withColumnRenamed("image_id", "path")
