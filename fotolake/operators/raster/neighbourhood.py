"""Neighbourhood filters in one shuffle.

Pixels are keyed by image and block of lines; lines next to a block are copied into it
(about 2 * radius / 64 more rows, not one copy per neighbour).  Two window passes, along
lines and along columns, then give each pixel its square of neighbours.  Both windows are
keyed inside (image, block), so they reuse that one partitioning, and a huge image is
spread over its blocks.  Beyond the border the edge pixel is repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.pixels import RGB, RGBA, luma
from . import core

BLOCK = 64


def _blocks(df: DataFrame, halo: int) -> DataFrame:
    last = F.floor((F.col("height") - 1) / BLOCK)
    at = lambda d: F.greatest(F.least(F.floor((F.col("y") + d) / BLOCK), last), F.lit(0)).cast("int")
    return df.withColumn("_block", F.explode_outer(F.sequence(at(-halo), at(halo)))).repartition("image_id", "_block")


def _own(df: DataFrame) -> DataFrame:
    return df.filter(F.floor(F.col("y") / BLOCK) == F.col("_block")).drop("_block")


SHIFTS = {"b": 0, "g": 8, "r": 16, "a": 24}
# The four bands of a pixel in one int, so that a window moves one value per neighbour.
PACKED = "b | shiftleft(g, 8) | shiftleft(r, 16) | shiftleft(coalesce(a, 0), 24)"


def level(packed: str, band: str) -> str:
    """SQL of one band of a packed pixel."""
    return f"(shiftright({packed}, {SHIFTS[band]}) & 255)"


def pack(values: dict[str, str]) -> str:
    return " | ".join(f"shiftleft({v}, {SHIFTS[c]})" for c, v in values.items())


def _neighbours(df: DataFrame, col: str, radius: int, over: str, name: str) -> tuple[DataFrame, list[str]]:
    """Columns of the values before, at and after; missing ones repeat the nearest."""
    def at(d):
        return col if d == 0 else f"{'lag' if d < 0 else 'lead'}({col}, {abs(d)}) OVER ({over})"

    cols = {}
    for d in range(-radius, radius + 1):
        nearer = range(d, 1) if d < 0 else range(d, -1, -1)
        cols[f"{name}{d + radius}"] = F.expr(f"coalesce({', '.join(at(e) for e in nearer)})")
    return df.withColumns(cols), list(cols)


@dataclass(frozen=True)
class Filter:
    """A square filter in two steps, as SQL text (far quicker to build than columns).

    ``across`` turns the packed pixels of a line into what has to be known of it: as
    little as the filter allows.  ``down`` turns those of the lines into the new value."""

    size: int
    across: Callable[[list[str]], str]
    down: Callable[[list[str], str], str]


def _step(df: DataFrame, f: Filter, bands, amount: str | None) -> DataFrame:
    r = f.size // 2
    d = df.withColumn("_p", F.expr(PACKED))
    d, line = _neighbours(d, "_p", r, "PARTITION BY image_id, _block, y ORDER BY x", "_h")
    d = d.withColumn("_l", F.expr(f.across(line))).drop(*line)
    d, rows = _neighbours(d, "_l", r, "PARTITION BY image_id, _block, x ORDER BY y", "_v")
    new = {}
    for c in bands:
        v = f.down(rows, c)
        if amount:
            v = f"cast(floor({c} + (({v}) - {c}) * ({amount})) AS int)"
        new[c] = F.expr(f"CASE WHEN {c} IS NOT NULL THEN {v} END")  # no alpha band stays so
    return d.withColumns(new).drop("_p", "_l", *rows)


def filtered(df: DataFrame, f: Filter, bands=RGBA, repeat: int = 1, amount=100, extra=()) -> DataFrame:
    """Apply a filter ``repeat`` times, blended at ``amount`` percent (a column may be given)
    each time.  The halo covers all repeats, so they share the one shuffle."""
    t = None
    if isinstance(amount, Column):
        df, t, extra = df.withColumn("_amount", amount), "_amount / 100.0D", (*extra, "_amount")
    elif amount < 100:
        t = f"{float(amount) / 100.0!r}D"
    d = df.select(*core.COLUMNS, *extra)
    done, radius = 0, f.size // 2
    while done < repeat:
        steps = min(repeat - done, max(1, BLOCK // max(1, radius)))
        d = _blocks(d, steps * radius)
        for _ in range(steps):
            d = _step(d, f, bands, t)
        d = _own(d)
        done += steps
    return d.drop("_amount")


def _extreme(df: DataFrame, size: int, fn: str, amount) -> DataFrame:
    """Smallest or largest: of each line first, then of the lines."""
    best = lambda values, c: f"{fn}({', '.join(level(v, c) for v in values)})"
    f = Filter(size, lambda line: pack({c: best(line, c) for c in RGBA}), best)
    return filtered(df, f, amount=amount)


def _square(rows: list[str], size: int, band: str) -> list[str]:
    return [level(f"{v}.n{i}", band) for v in rows for i in range(size)]


def _whole_line(line: list[str]) -> str:
    return "named_struct(" + ", ".join(f"'n{i}', {n}" for i, n in enumerate(line)) + ")"


def minimum(df: DataFrame, size=3, amount=100) -> DataFrame:
    return _extreme(df, size, "least", amount)


def maximum(df: DataFrame, size=3, amount=100) -> DataFrame:
    return _extreme(df, size, "greatest", amount)


def _rank(df, size, index, amount):
    if index in (0, size * size - 1):
        return _extreme(df, size, "greatest" if index else "least", amount)
    pick = lambda rows, c: f"sort_array(array({', '.join(_square(rows, size, c))}))[{index}]"
    return filtered(df, Filter(size, _whole_line, pick), amount=amount)


def median(df: DataFrame, size=3, amount=100) -> DataFrame:
    return _rank(df, size, size * size // 2, amount)


def rank(df: DataFrame, size=3, rank=50, amount=100) -> DataFrame:
    return _rank(df, size, int((size * size - 1) * rank / 100.0), amount)


def common(df: DataFrame, size=3, amount=100) -> DataFrame:
    """Most common value of the square, the smallest of equals: one walk over the sorted
    values, keeping the longest run."""
    run = "CASE WHEN v = acc.v THEN acc.run + 1 ELSE 1 END"

    def mode(rows, band):
        return (
            f"aggregate(sort_array(array({', '.join(_square(rows, size, band))})), "
            "named_struct('v', -1, 'run', 0, 'best', -1, 'n', 0), "
            f"(acc, v) -> named_struct('v', v, 'run', {run}, 'best', CASE WHEN ({run}) > acc.n THEN v ELSE acc.best END, "
            f"'n', greatest({run}, acc.n)), acc -> acc.best)")

    return filtered(df, Filter(size, _whole_line, mode), amount=amount)


# Kernels by lines, their divisor and offset.
KERNELS = {
    "blur": ([1, 1, 1, 1, 1, 1, 0, 0, 0, 1, 1, 0, 0, 0, 1, 1, 0, 0, 0, 1, 1, 1, 1, 1, 1], 16, 0),
    "contour": ([-1, -1, -1, -1, 8, -1, -1, -1, -1], 1, 255),
    "detail": ([0, -1, 0, -1, 10, -1, 0, -1, 0], 6, 0),
    "edge enhance": ([-1, -1, -1, -1, 10, -1, -1, -1, -1], 2, 0),
    "edge enhance more": ([-1, -1, -1, -1, 9, -1, -1, -1, -1], 1, 0),
    "emboss": ([-1, 0, 0, 0, 1, 0, 0, 0, 0], 1, 128),
    "find edges": ([-1, -1, -1, -1, 8, -1, -1, -1, -1], 1, 0),
    "smooth": ([1, 1, 1, 1, 5, 1, 1, 1, 1], 13, 0),
    "smooth more": ([1, 1, 1, 1, 1, 1, 5, 5, 5, 1, 1, 5, 44, 5, 1, 1, 5, 5, 5, 1, 1, 1, 1, 1, 1], 100, 0),
    "sharpen": ([-2, -2, -2, -2, 32, -2, -2, -2, -2], 16, 0),
}
KEEP_ALPHA = ("contour", "emboss")


def kernel_filter(kernel: str, bands=RGBA) -> Filter:
    """Weighted sum by lines: a line is known by its sum for each different kernel row,
    so only those few ints move down the columns."""
    weights, divisor, offset = KERNELS[kernel]
    size = 5 if len(weights) == 25 else 3
    lines = [tuple(weights[j * size:(j + 1) * size]) for j in range(size)]
    kinds = [k for k in dict.fromkeys(lines) if any(k)]

    def across(line):
        sums = []
        for i, kind in enumerate(kinds):
            for c in bands:
                total = " + ".join(f"{level(n, c)} * {w}" for n, w in zip(line, kind) if w)
                sums.append(f"'{c}{i}', {total}")
        return f"named_struct({', '.join(sums)})"

    def down(rows, band):
        total = " + ".join(f"{v}.{band}{kinds.index(k)}" for v, k in zip(rows, lines) if any(k))
        return f"cast(least(greatest(floor(({total}) / {float(divisor)}D) + {offset}, 0), 255) AS int)"

    return Filter(size, across, down)


def effect(df: DataFrame, kernel="blur", amount=100, repeat=1, extra=()) -> DataFrame:
    """Convolution by name, repeated and blended each time."""
    bands = RGB if kernel in KEEP_ALPHA else RGBA
    return filtered(df, kernel_filter(kernel, bands), bands, repeat, amount, extra)


def sketch(df: DataFrame, details=1) -> DataFrame:
    """Pencil drawing: luma divided by its blurred negative."""
    grey = luma()
    d = df.select(*core.SHAPE, grey.alias("r"), (255 - grey).alias("g"), F.lit(0).alias("b"),
                  F.lit(None).cast("int").alias("a"))
    d = filtered(d, kernel_filter("blur", ("g",)), ("g",), details)
    v = F.least(F.floor(F.col("r") * 255 / (256 - F.col("g"))), F.lit(255)).cast("int")
    return d.withColumn("_v", v).withColumns({c: F.col("_v") for c in RGB}).select(*core.COLUMNS)
