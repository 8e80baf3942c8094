"""Comparing two runs: new, missing, mismatching and equal images, with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.pixels import RGBA
from ..session import broadcast_within, written


# Side of a tile in pixels, as a power of two, and how many differing tiles are broadcast.
TILE_BITS = 6
OPEN_TILES = 1_000_000
TILE = ("image_id", "_ty", "_tx")


def _tiled(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({"_ty": F.shiftright("y", TILE_BITS), "_tx": F.shiftright("x", TILE_BITS)})


def tile_digests(pixels: DataFrame, *keys: str) -> DataFrame:
    """image_id, tile, digest, n and whether there is alpha: the lower level of an image's digests.  Each pixel hashes
    with its position and the hashes are added, so partial sums combine in any order."""
    h = F.xxhash64("x", "y", *[F.coalesce(c, F.lit(-1)) for c in RGBA])
    return _tiled(pixels).groupBy(*TILE, *keys).agg(
        F.sum(h.cast("decimal(38,0)")).alias("digest"), F.count("*").alias("n"), F.max(F.col("a").isNotNull()).alias("has"))


def pixel_digest(pixels: DataFrame) -> DataFrame:
    """image_id, width, height, mode and an order-free digest of all pixels: the sum of the tiles' digests."""
    tiles = tile_digests(pixels, "width", "height")
    return tiles.groupBy("image_id", "width", "height").agg(
        F.sum("digest").cast("decimal(38,0)").alias("digest"), F.when(F.max("has"), "RGBA").otherwise("RGB").alias("mode"))


def open_tiles(first: DataFrame, second: DataFrame) -> DataFrame:
    """image_id, tile and whether its digests differ, for each tile that one side has."""
    b = tile_digests(second).select(*TILE, F.col("digest").alias("_digest"), F.col("n").alias("_n"))
    j = tile_digests(first).join(b, list(TILE), "full_outer")
    same = F.col("digest").eqNullSafe(F.col("_digest")) & F.col("n").eqNullSafe(F.col("_n"))
    return j.select(*TILE, (~same).alias("differs"))


def max_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Largest band difference per image; a pixel that only one side has differs by 255.

    Only pixels of tiles whose digests differ are joined: the others are left out before the shuffle."""
    tiles = written(open_tiles(first, second), "tiles")
    todo = broadcast_within(tiles.filter("differs").select(*TILE), OPEN_TILES)
    mine, theirs = (_tiled(side).join(todo, list(TILE), "left_semi") for side in (first, second))
    b = theirs.select("image_id", "x", "y", F.lit(True).alias("_in"), *[F.col(c).alias("_" + c) for c in RGBA])
    bands = F.greatest(*[F.abs(F.coalesce(c, F.lit(255)) - F.coalesce("_" + c, F.lit(255))) for c in RGBA])
    gap = F.when(F.col("_in") & F.col("in"), bands).otherwise(F.lit(255))
    found = mine.select("image_id", "x", "y", F.lit(True).alias("in"), *RGBA).join(b, ["image_id", "x", "y"], "full_outer")
    known = tiles.select("image_id", F.lit(0).alias("gap")).distinct()
    return found.select("image_id", gap.alias("gap")).unionByName(known).groupBy("image_id").agg(
        F.max("gap").alias("difference"), F.count_if(F.col("gap") > 0).alias("pixels"))


def corpus_diff(old: DataFrame, new: DataFrame, tags: bool = False) -> DataFrame:
    """image_id and status: new, missing, same, or the first reason of a mismatch - mode,
    size, metadata, pixels.  Only digests are joined."""
    a, b = pixel_digest(old), pixel_digest(new)
    o = a.select("image_id", *[F.col(c).alias("o_" + c) for c in ("width", "height", "mode", "digest")])
    j = o.join(b, "image_id", "full_outer")
    return j.select(
        "image_id",
        F.when(F.col("o_width").isNull(), "new")
        .when(F.col("width").isNull(), "missing")
        .when(F.col("o_mode") != F.col("mode"), "mismatch: mode")
        .when((F.col("o_width") != F.col("width")) | (F.col("o_height") != F.col("height")), "mismatch: size")
        .when(F.col("o_digest") != F.col("digest"), "mismatch: pixels")
        .otherwise("same").alias("status"),
    )


def tag_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed cells of two long tag tables."""
    b = new.select("image_id", "tag", F.col("value").alias("new_value"))
    return (
        old.select("image_id", "tag", F.col("value").alias("old_value"))
        .join(b, ["image_id", "tag"], "full_outer")
        .filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
    )


def with_tag_status(status: DataFrame, changes: DataFrame) -> DataFrame:
    """Turns ``same`` into ``mismatch: metadata`` where tags differ."""
    changed = changes.select("image_id").distinct().withColumn("_m", F.lit(True))
    return status.join(changed, "image_id", "left").withColumn(
        "status", F.when((F.col("status") == "same") & F.col("_m"), "mismatch: metadata").otherwise(F.col("status"))
    ).drop("_m")
