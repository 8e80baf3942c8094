"""Action parameters: field texts checked on the driver or turned into columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession, functions as F

from ..functions import templates as TP
from ..functions.paths import IMAGE_EXTENSIONS
from ..functions.pixels import rgb_of
from ..functions.units import LENGTH, SIZE, length_px, size_bytes

TRUE, FALSE = ("1", "yes", "true", "on"), ("0", "no", "false", "off")
TAG_LIKE = r"^(Exif|Iptc)_\w+$"


class InvalidField(ValueError):
    """A field value that its kind does not allow."""


@dataclass(frozen=True)
class Param:
    """One field: its label in action lists, its kind, its default and limits."""

    label: str
    kind: str
    default: str
    low: float | None = None
    high: float | None = None
    choices: tuple = field(default=())
    base: object = None  # what 100% of a length stands for, as columns of the image size
    per_image: bool = False  # a number that may differ between images

    def constant(self, text: str):
        """Value of a field without variables."""
        t = str(text).strip()
        if self.kind in ("int", "slider", "float"):
            try:
                v = float(t) if self.kind == "float" else int(round(float(t)))
            except ValueError:
                raise InvalidField(f"{self.label}: invalid literal {t!r}") from None
            if self.low is not None and v < self.low or self.high is not None and v > self.high:
                raise InvalidField(f"{self.label}: {v} is not between {self.low} and {self.high}")
            if self.choices and v not in self.choices:
                raise InvalidField(f"{self.label}: {v} is not one of {', '.join(map(str, self.choices))}")
            return v
        if self.kind == "bool":
            if t.lower() not in TRUE + FALSE:
                raise InvalidField(f"{self.label}: {t!r} is not yes or no")
            return t.lower() in TRUE
        if self.kind == "choice":
            if t not in self.choices:
                raise InvalidField(f"{self.label}: {t!r} is not one of {', '.join(map(str, self.choices))}")
            return t
        if self.kind == "color":
            try:
                rgb_of(t)
            except ValueError as e:
                raise InvalidField(f"{self.label}: {e}") from None
            return t
        if self.kind == "tag":
            if not re.match(TAG_LIKE, t):
                raise InvalidField(f"{self.label}: {t!r} is not an Exif or Iptc tag")
            return t
        if self.kind == "extension":
            if t.lower() not in IMAGE_EXTENSIONS + ["eps", "ps", "pdf"]:
                raise InvalidField(f"{self.label}: {t!r} is not an image type")
            return t
        if self.kind == "text":
            return str(text)
        raise InvalidField(f"{self.label}: {self.kind} needs a column")

    def check(self, text: str, variables) -> list[str]:
        """Problems of a field text, found before anything runs."""
        bad = TP.check_template(str(text), variables)
        if bad:
            return [f"{self.label}: {b}" for b in bad]
        if self.kind in ("length", "size", "dpi"):
            # With every part read as a number the text must be a length or size.
            shape = TP.PART.sub("1", str(text))
            if self.kind == "dpi" and not re.fullmatch(r"\s*0*[1-9][0-9]*(\.[0-9]+)?\s*", shape):
                return [f"{self.label}: {text!r} is not a dpi"]
            good = re.match(SIZE if self.kind == "size" else LENGTH, shape)
            return [] if good else [f"{self.label}: {text!r} is not a {self.kind}"]
        if "<" in str(text) or self.kind == "text":
            return []
        try:
            self.constant(text)
        except InvalidField as e:
            return [str(e)]
        return []

    def value(self, text: str, variables):
        """Python value of a constant field, else a column over the image's variables."""
        text = str(text)
        if self.kind in ("length", "size", "dpi"):
            col = TP.template(text, variables) if "<" in text else F.lit(text)
            if self.kind == "length":
                return length_px(col if "<" in text else text, self.base() if self.base else F.lit(0), F.col("dpi"))
            if self.kind == "size":
                return size_bytes(col)
            return F.when(col.try_cast("double") > 0, col.try_cast("double").cast("int"))
        if self.kind == "text" or "<" not in text:
            return self.constant(text)
        if not TP.required_vars(text):
            return self.constant(SparkSession.active().range(1).select(TP.template(text, variables)).first()[0])
        if not self.per_image:
            raise InvalidField(f"{self.label}: must be the same for all images")
        col = TP.template(text, variables)
        if self.kind in ("int", "slider"):
            v = F.round(col.try_cast("double")).cast("int")
        else:
            v = col.try_cast("double")
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (v >= F.lit(self.low))
        if self.high is not None:
            ok = ok & (v <= F.lit(self.high))
        return F.when(ok, v)  # out of range is NULL: an issue of that image


def width() -> Column:
    return F.col("width")


def height() -> Column:
    return F.col("height")


def mean_side() -> Column:
    return F.floor((F.col("width") + F.col("height")) / F.lit(2))


def true_mean_side() -> Column:
    return (F.col("width") + F.col("height")) / F.lit(2.0)


def slider(label, default, low, high) -> Param:
    return Param(label, "slider", str(default), low, high)


def amount(default=100, low=1) -> Param:
    return Param("Amount", "slider", str(default), low, 100, per_image=True)


def length(label, default, base) -> Param:
    return Param(label, "length", default, base=base)


def choice(label, default, *choices) -> Param:
    return Param(label, "choice", default, choices=choices or (default,))


def yes_no(label, default) -> Param:
    return Param(label, "bool", "yes" if default else "no")


def color(label, default) -> Param:
    return Param(label, "color", default)


def text(label, default="") -> Param:
    return Param(label, "text", default)
