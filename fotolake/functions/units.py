"""Lengths, file sizes, placement and proportions as columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, functions as F

from .pixels import as_column

NUMBER = r"[0-9]*\.?[0-9]+"
FACTOR = rf"{NUMBER}\s*(?:px|cm|mm|inch|%)?"
TERM = rf"{FACTOR}(?:\s*[*/]\s*{FACTOR})*"
SIGNS = r"[+-]?\s*[+-]?\s*"
LENGTH = rf"^\s*{SIGNS}{TERM}(?:\s*[+-]\s*[+-]?\s*{TERM})*\s*$"
SIZE = r"^\s*([0-9]*\.?[0-9]+)\s*(bt|kb|mb|gb)?\s*$"


def round_half_away(c: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.when(c < 0, -F.floor(-c + F.lit(0.5))).otherwise(F.floor(c + F.lit(0.5))).cast("long")


def _times(value: Column, whole: Column, divides: Column, number: Column, factor: Column) -> Column:
    """A term's value after one more factor; whole numbers are divided without a rest."""
    ratio = F.try_divide(value, number)
    return F.when(divides, F.when(whole, F.floor(ratio).cast("double")).otherwise(ratio)).otherwise(value * number) * factor


def length_px(text, base, dpi=72) -> Column:
    """Pixels of ``"5%"``, ``"2 cm"``, ``"1 inch"``, ``"10px"``, a bare number, or sums and products of such
    (``"50% - 10px"``, ``"2*1cm"``).  A unit counts for all that stands before it in its term.
    ``base`` is what 100% stands for.  Anything else gives NULL, division by zero too."""
    base, dpi = as_column(base).cast("double"), as_column(dpi).cast("double")
    factors = {"%": base / F.lit(100.0), "cm": dpi / F.lit(2.54), "mm": dpi / F.lit(25.4), "inch": dpi}
    if not isinstance(text, Column):
        return _literal_px(str(text), factors)

    def factor_of(unit: Column) -> Column:
        out = F.lit(1.0)
        for name, factor in factors.items():
            out = F.when(unit == name, factor).otherwise(out)
        return out

    def step(state: Column, part: Column) -> Column:
        number, unit = F.regexp_extract(part, NUMBER, 0), F.regexp_extract(part, "[a-z%]+", 0)
        whole = state["whole"] & ~number.contains(".")
        value = _times(state["value"], whole, part.startswith("/"), number.cast("double"), factor_of(unit))
        return F.struct(value.alias("value"), (whole & unit.isin("", "px")).alias("whole"))

    def term(found: Column) -> Column:
        parts = F.regexp_extract_all(found, F.lit(rf"[*/]?\s*{FACTOR}"), F.lit(0))
        value = F.aggregate(parts, F.struct(F.lit(1.0).alias("value"), F.lit(True).alias("whole")), step)["value"]
        return F.when(F.length(F.regexp_replace(found, "[^-]", "")) == 1, -value).otherwise(value)

    text = text.cast("string")
    terms = F.regexp_extract_all(text, F.lit(SIGNS + TERM), F.lit(0))
    return F.when(text.rlike(LENGTH), round_half_away(F.aggregate(terms, F.lit(0.0), lambda a, t: a + term(t))))


def _literal_px(text: str, factors: dict[str, Column]) -> Column:
    """The same for a fixed text, as plain arithmetic."""
    if not re.match(LENGTH, text):
        return F.lit(None).cast("long")
    total = None
    for found in re.findall(SIGNS + TERM, text):
        value, whole, negative = F.lit(1.0), True, found.count("-") == 1
        for op, number, unit in re.findall(rf"([*/]?)\s*({NUMBER})\s*(px|cm|mm|inch|%)?", found):
            whole = whole and "." not in number
            value = _times(value, F.lit(whole), F.lit(op == "/"), F.lit(float(number)), factors.get(unit, F.lit(1.0)))
            whole = whole and unit in ("", "px")
        value = -value if negative else value
        total = value if total is None else total + value
    return round_half_away(total)


def size_bytes(text) -> Column:
    """Bytes of ``"5kb"``, ``"5 mb"`` or ``"10 bt"``; anything else gives NULL."""
    text = F.lit(text) if not isinstance(text, Column) else text.cast("string")
    number = F.regexp_extract(text, SIZE, 1)
    unit = F.regexp_extract(text, SIZE, 2)
    factor = F.when(unit == "kb", 1024).when(unit == "mb", 1048576).when(unit == "gb", 1073741824).otherwise(1)
    return F.when(number != "", round_half_away(number.try_cast("double") * factor))


def _scale_of(box: Column, size: Column) -> Column:
    """What makes ``size`` as large as ``box``; a size of 0 never reaches it."""
    return F.when(size == 0, F.lit(math.inf)).otherwise(F.try_divide(box, size))


def fit_inside(w, h, box_w, box_h) -> tuple[Column, Column]:
    """Largest size of ratio w:h within the box; the tighter side is kept exactly.  A side of 0 becomes 1."""
    w, h, bw, bh = (as_column(c).cast("double") for c in (w, h, box_w, box_h))
    sx, sy = _scale_of(bw, w), _scale_of(bh, h)
    out_w = F.when(sx < sy, bw.cast("long")).when(w != 0, F.floor(w * sy + 0.5))
    out_h = F.when(sx < sy, F.when(h != 0, F.floor(h * sx + 0.5))).otherwise(bh.cast("long"))
    return F.greatest(out_w.cast("long"), F.lit(1)), F.greatest(out_h.cast("long"), F.lit(1))


def _half(c: Column) -> Column:
    """Minus half the size, floored like the integer division it stands for."""
    return F.floor(-c / F.lit(2))


def place(offset, justify: str, canvas, size) -> Column:
    """Start coordinate on one axis.  A negative offset counts from the far edge."""
    offset, canvas, size = (as_column(c).cast("long") for c in (offset, canvas, size))
    start = F.when(offset < 0, offset + canvas).otherwise(offset)
    if justify in ("Left", "Top"):
        return start
    if justify == "Middle":
        return (start + _half(size)).cast("long")
    if justify in ("Right", "Bottom"):
        return start - size
    raise ValueError(f"unknown justification {justify!r}")


def negate_length(text: str) -> str:
    """``5%`` to ``-5%`` and back."""
    text = text.strip()
    return text[1:].strip() if text.startswith("-") else "-" + text


def position_preset(position: str, offset: str = "5%", custom: dict | None = None) -> dict[str, str]:
    """Offsets and justifications of a named position such as ``Top Left`` or ``Center``."""
    if position == "Center":
        return {"h": "50%", "hj": "Middle", "v": "50%", "vj": "Middle"}
    if position == "Custom":
        return dict(custom or {"h": "50%", "hj": "Middle", "v": "-5%", "vj": "Middle"})
    left, top = "Left" in position, "Top" in position
    return {
        "h": offset if left else negate_length(offset),
        "hj": "Left" if left else "Right",
        "v": offset if top else negate_length(offset),
        "vj": "Top" if top else "Bottom",
    }
