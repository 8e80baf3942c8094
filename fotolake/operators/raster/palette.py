"""Palettes by median cut, and images in their nearest palette colours.

Work is on distinct colours with their counts, never on pixels: counts are combined before
the shuffle, and an image has at most 2^24 colours whatever its size.  Pixels then look
their colour's entry up by image, tile and colour, so a large image stays spread.

A box of colours is split across its widest band (red before green before blue in ties)
where half of its pixels are passed: colours in order of that band, then of the others,
stay below while the pixels up to and with them are at most half of the box, and the first
colour always does.  All boxes are split in each round; a box of one colour stays one.  An
entry is the floor of a box's mean, entries are numbered in order of their boxes.  A colour
takes the nearest entry by squared distance, the first of equals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ...functions.pixels import RGB
from ..skew import salted_lookup
from . import core

MOST = 256


def boxes(df: DataFrame, rounds: int) -> DataFrame:
    """image_id, r, g, b, n and the box of each distinct colour after ``rounds`` splits."""
    d = df.groupBy("image_id", *RGB).agg(F.count("*").alias("n")).withColumn("box", F.lit(0))
    for _ in range(rounds):
        one = Window.partitionBy("image_id", "box")
        spread = {c: F.max(c).over(one) - F.min(c).over(one) for c in RGB}
        d = d.withColumns({f"_{c}": spread[c] for c in RGB})
        widest = F.when((F.col("_r") >= F.col("_g")) & (F.col("_r") >= F.col("_b")), F.col("r"))
        widest = widest.when(F.col("_g") >= F.col("_b"), F.col("g")).otherwise(F.col("b"))
        d = d.withColumn("_key", widest)
        order = one.orderBy("_key", *RGB)
        so_far = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        low = (2 * so_far <= F.sum("n").over(one)) | (F.row_number().over(order) == 1)
        d = d.withColumn("box", 2 * F.col("box") + F.when(low, 0).otherwise(1)).drop("_key", *[f"_{c}" for c in RGB])
    return d


def palette(df: DataFrame, colors: int = MOST) -> DataFrame:
    """image_id, entry, r, g, b: at most ``colors`` (a power of two) entries of each image."""
    return _entries(boxes(df, _rounds(colors)))


def _rounds(colors: int) -> int:
    if not 1 <= colors <= MOST or colors & (colors - 1):
        raise ValueError(f"a palette has 1 to {MOST} colours, a power of two")
    return colors.bit_length() - 1


def _entries(cut: DataFrame) -> DataFrame:
    mean = lambda c: F.floor(F.sum(F.col(c) * F.col("n")) / F.sum("n")).cast("int").alias(c)
    found = cut.groupBy("image_id", "box").agg(*[mean(c) for c in RGB])
    return found.withColumn("entry", F.row_number().over(Window.partitionBy("image_id").orderBy("box")) - 1).select("image_id", "entry", *RGB)


def _nearest(colours: DataFrame, entries: DataFrame) -> DataFrame:
    """image_id, r, g, b and the nearest entry: p, pr, pg, pb.  An image's palette is one array of at most MOST entries."""
    whole = entries.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("entry", *RGB))).alias("all"))
    d = salted_lookup(colours, whole, ["image_id"], F.hash(*RGB))
    far = lambda e: sum(((F.col(c) - e[c]) * (F.col(c) - e[c]) for c in RGB), F.lit(0))
    best = F.array_min(F.transform("all", lambda e: F.struct(far(e).alias("d"), e["entry"].alias("p"), *[e[c].alias("p" + c) for c in RGB])))
    return d.select("image_id", *RGB, best.alias("best")).select("image_id", *RGB, "best.p", *["best.p" + c for c in RGB])


def quantized(df: DataFrame, colors: int = MOST) -> DataFrame:
    """Pixels with ``p``, the number of their palette entry, and the entry's colour; no alpha."""
    cut = boxes(df, _rounds(colors))
    facts = _nearest(cut, _entries(cut)).join(df.filter((F.col("x") == 0) & (F.col("y") == 0)).select("image_id", "width", "height"), "image_id")
    out = core.join_per_image(df.drop("a"), facts, on=RGB)
    bands = {c: F.col("p" + c) for c in RGB}
    return core.integers(out.withColumns({**bands, "a": F.lit(None).cast("int")}), ["p"])
