"""Column arithmetic shared by all raster operators.  Values are ints in 0..255."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RGB = ("r", "g", "b")
RGBA = ("r", "g", "b", "a")


def as_column(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def clamp(c: Column) -> Column:
    """Limited to a byte; NULL would become 0, so missing alpha is handled by the caller."""
    return F.least(F.greatest(c, F.lit(0)), F.lit(255)).cast("int")


def floor_byte(c: Column) -> Column:
    """Floor of a double, limited to a byte."""
    return clamp(F.floor(c))


def blend(a: Column, b: Column, amount) -> Column:
    """floor(a + (b - a) * amount / 100).  Between two bytes, so it needs no clamp; leaving
    that out keeps the compiled methods small enough for the JVM's compiler."""
    if not isinstance(amount, Column):
        t = F.lit(float(amount) / 100.0)
    else:
        t = amount.cast("double") / F.lit(100.0)
    return F.floor(a + (b - a) * t).cast("int")


def over(dst: Column, src: Column, mask: Column) -> Column:
    """Composite ``src`` on ``dst`` with a 0..255 mask: floor(dst + (src - dst) * mask / 255)."""
    return F.floor(dst + (src - dst) * mask / F.lit(255.0)).cast("int")


def scale_by(v: Column, opacity) -> Column:
    """floor(v * opacity / 100)."""
    return F.floor(v * as_column(opacity).cast("double") / F.lit(100.0)).cast("int")


def luma(r="r", g="g", b="b") -> Column:
    """BT.601 luma in integers."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (r, g, b)]
    return F.floor((cols[0] * 299 + cols[1] * 587 + cols[2] * 114) / 1000).cast("int")


def idiv(a, b) -> Column:
    """Integer floor division of non-negative values, JVM side."""
    a, b = as_column(a), as_column(b)
    return ((a - F.pmod(a, b)) / b).cast("long")


def ceil_div(a, b) -> Column:
    a, b = as_column(a), as_column(b)
    return F.ceil(a / b).cast("long")


def rgb_of(color: str) -> tuple[int, int, int]:
    """``#RRGGBB`` to three ints."""
    s = color.lstrip("#")
    if len(s) != 6 or any(ch not in "0123456789abcdefABCDEF" for ch in s):
        raise ValueError(f"not a colour: {color!r}")
    return int(s[0:2], 16), int(s[2:4], 16), int(s[4:6], 16)


def hex_band(col: Column, band: int) -> Column:
    """One band of a ``#RRGGBB`` text column."""
    return F.conv(F.substring(col, 2 + 2 * band, 2), 16, 10).cast("int")


def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)
