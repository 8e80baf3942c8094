"""Pixel tables: image_id, width, height, x, y, r, g, b, a (NULL a: no alpha band).

Every pixel carries its image's size, so most geometry needs no join.  Where facts per
image do have to be joined, or pixels gathered, keys always include a piece of the
position: a single huge image spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.pixels import RGB, RGBA, as_column, rgb_of

SHAPE = ("image_id", "width", "height", "x", "y")
COLUMNS = SHAPE + RGBA
# Pixels of one image that share a join key, and of a packed strip.
TILE = 1 << 20
STRIP = 1 << 18


def integers(df: DataFrame, keep=()) -> DataFrame:
    """Column order and int types of a pixel table; ``keep`` names columns carried along."""
    return df.select("image_id", *[F.col(c).cast("int").alias(c) for c in COLUMNS[1:]], *keep)


def unpack(rasters: DataFrame) -> DataFrame:
    """Packed ``data`` (ordered by y, x, band; 1 to 4 bands) to pixels, without a shuffle."""
    n, k = F.col("bands"), F.col("k")
    at = lambda i: F.get("data", k * n + i)
    colour = n >= 3
    return integers(
        rasters.withColumn("k", F.explode_outer(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1))).select(
            "image_id", "width", "height",
            F.pmod(k, F.col("width")).alias("x"), F.floor(k / F.col("width")).alias("y"),
            at(0).alias("r"),
            F.when(colour, at(1)).otherwise(at(0)).alias("g"),
            F.when(colour, at(2)).otherwise(at(0)).alias("b"),
            F.when(n == 4, at(3)).when(n == 2, at(1)).alias("a"),
        )
    )


def pack_strips(pixels: DataFrame) -> DataFrame:
    """Packed strips of whole lines: image_id, strip, y0, rows, width, height, bands, data.
    A strip holds about STRIP pixels, so an image of any size never lands in one group."""
    lines = F.greatest(F.floor(F.lit(STRIP) / F.col("width")), F.lit(1))
    value = F.when(F.col("a").isNull(), F.array(*RGB)).otherwise(F.array(*RGBA))
    return (
        pixels.withColumn("strip", F.floor(F.col("y") / lines).cast("int"))
        .groupBy("image_id", "width", "height", "strip")
        .agg(F.sort_array(F.collect_list(F.struct("y", "x", value.alias("v")))).alias("p"))
        .select(
            "image_id", "strip", F.col("p")[0]["y"].alias("y0"),
            (F.element_at("p", -1)["y"] - F.col("p")[0]["y"] + 1).alias("rows"),
            "width", "height", F.size(F.col("p")[0]["v"]).alias("bands"),
            F.flatten(F.transform("p", lambda s: s["v"])).alias("data"),
        )
    )


def tile_of() -> Column:
    """Number of the tile a pixel lies in; images up to TILE pixels have only tile 0."""
    return F.floor((F.col("y").cast("long") * F.col("width") + F.col("x")) / F.lit(TILE)).cast("int")


def join_per_image(pixels: DataFrame, facts: DataFrame, how: str = "inner", on: tuple[str, ...] = ()) -> DataFrame:
    """Join rows keyed by image (and ``on``).  The key gets the tile number, and a fact is
    repeated once per tile of its image, so the copies grow only with the image."""
    last = F.floor((F.col("width").cast("long") * F.col("height") - 1) / F.lit(TILE)).cast("int")
    spread = facts.withColumn("_tile", F.explode_outer(F.sequence(F.lit(0), last))).drop("width", "height")
    return pixels.withColumn("_tile", tile_of()).join(spread, ["image_id", "_tile", *on], how).drop("_tile")


def line_heads(df: DataFrame) -> DataFrame:
    """The first pixel of each line stands for the line: one row per image line, no shuffle."""
    return df.filter(F.col("x") == 0)


def _share_of_lines(th: Column) -> tuple[Column, Column]:
    """First and last target line a source line answers for: its proportional share, so a
    large target is spread like its source."""
    y, h = F.col("y").cast("long"), F.col("height")
    return F.ceil(y * th / h).cast("int"), (F.ceil((y + 1) * th / h) - 1).cast("int")


def target_grid(df: DataFrame, tw, th, keep: list[str] | None = None) -> DataFrame:
    """All pixels (tx, ty) of each image's tw x th target, from one row per source line."""
    heads = line_heads(df).select(
        "image_id", "width", "height", "y", *(keep or []),
        as_column(tw).cast("int").alias("tw"), as_column(th).cast("int").alias("th"),
    )
    lo, hi = _share_of_lines(F.col("th"))
    return (
        heads.withColumns({"_lo": lo, "_hi": hi})
        .filter((F.col("_lo") <= F.col("_hi")) & (F.col("tw") > 0))
        .withColumn("ty", F.explode_outer(F.sequence("_lo", "_hi")))
        .withColumn("tx", F.explode_outer(F.sequence(F.lit(0), F.col("tw") - 1)))
        .drop("_lo", "_hi", "y")
    )


OWN = "_copy"  # number of the copy of a source pixel, -1 on a filled-in pixel


def copies_and_fill(df: DataFrame, tw, th, copies: Column, fill_where=None) -> DataFrame:
    """Each pixel becomes one row per entry of ``copies`` (small ints), and the first pixel
    of a line also emits the target pixels (_tx, _ty), those for which ``fill_where`` holds.
    One pass over the source: nothing before this is computed twice."""
    d = df.withColumns({"_tw": as_column(tw).cast("int"), "_th": as_column(th).cast("int")})
    lo, hi = _share_of_lines(F.col("_th"))
    head = (F.col("x") == 0) & (lo <= hi) & (F.col("_tw") > 0)
    lines = F.when(head, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    # Copies are coded below zero, so that one array of ints holds both.
    codes = F.concat(F.transform(copies, lambda k: -1 - k), lines)
    # explode_outer throughout: explode would first filter on the array's size and so
    # compute the array again; its NULL rows are dropped here.
    d = d.withColumn("_ty", F.explode_outer(codes)).filter(F.col("_ty").isNotNull())
    here = F.when(F.col("_ty") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("_tw") - 1))
    d = d.withColumn("_tx", F.explode_outer(here))
    if fill_where is not None:
        d = d.filter((F.col("_ty") < 0) | fill_where(F.col("_tx"), F.col("_ty")))
    return d.withColumn(OWN, F.when(F.col("_ty") < 0, -1 - F.col("_ty")).otherwise(F.lit(-1)))


def computed_once(d: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-element generator.  Filters and projections after it use
    the values; without it the optimiser copies the expressions into every use and the
    compiled method grows past what the JVM compiles."""
    one = F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))
    return d.withColumn("_one", F.explode_outer(one)).select("*", "_one.*").drop("_one")


def either(own: Column, filled: Column) -> Column:
    return F.when(F.col(OWN) >= 0, own).otherwise(filled)


def place_copies(d: DataFrame, x: Column, y: Column, own: dict[str, Column], filled: dict[str, Column],
                 keep=()) -> DataFrame:
    """Pixel table of ``copies_and_fill`` rows: positions and bands of copies, and the
    solid values of filled-in pixels."""
    return integers(d.select(
        "image_id", F.col("_tw").alias("width"), F.col("_th").alias("height"),
        either(x, F.col("_tx")).alias("x"), either(y, F.col("_ty")).alias("y"),
        *[either(own[c], filled[c]).alias(c) for c in RGBA], *keep), keep)


def solid(color: str, alpha=None) -> dict[str, Column]:
    return {**{c: F.lit(v) for c, v in zip(RGB, rgb_of(color))}, "a": as_column(alpha).cast("int")}


def bands() -> dict[str, Column]:
    return {c: F.col(c) for c in RGBA}


def per_band(df: DataFrame, fn, bands=RGB) -> DataFrame:
    """Replace each colour band by ``fn(column, band number)``."""
    return df.withColumns({c: fn(F.col(c), i) for i, c in enumerate(bands)})
