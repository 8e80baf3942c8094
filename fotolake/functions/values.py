"""Tag value helpers: date texts, rationals, degrees."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .pixels import as_column

EXIF_TIME = "yyyy:MM:dd HH:mm:ss"
# Fixed pattern of a tag date.
EXIF_TIME_PATTERN = r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"

# The named parts of a date tag, as Spark SQL over a timestamp ``t``.
DATE_PARTS = {
    "year": "year(t)",
    "month": "month(t)",
    "day": "day(t)",
    "hour": "hour(t)",
    "minute": "minute(t)",
    "second": "second(t)",
    "weekday": "weekday(t)",
    "weekdayname": "date_format(t, 'EEEE')",
    "monthname": "date_format(t, 'MMMM')",
}


def exif_time(value: Column) -> Column:
    """Timestamp of a date tag, NULL when it is not one."""
    return F.try_to_timestamp(value, F.lit(EXIF_TIME))


def exif_text(ts: Column) -> Column:
    return F.date_format(ts, EXIF_TIME)


def shift_time(ts: Column, years=0, months=0, days=0, hours=0, minutes=0, seconds=0) -> Column:
    """Calendar shift: years and months first with month-end clamp, then the rest."""
    y, mo, d, h, mi, s = (as_column(v).cast("int") for v in (years, months, days, hours, minutes, seconds))
    return ts + F.make_interval(y, mo, F.lit(0), d, h, mi, s)


def rational(num: Column, den: Column) -> Column:
    return F.struct(num.cast("long").alias("num"), den.cast("long").alias("den"))


def parse_rational(text: Column) -> Column:
    """``"num/den"`` to a rational; NULL for any other text."""
    ok = text.rlike(r"^-?\d+/\d+$")
    parts = F.split(text, "/")
    return F.when(ok, rational(parts[0].try_cast("long"), parts[1].try_cast("long")))


def degrees(angle: Column) -> Column:
    return F.floor(F.abs(angle)).cast("int")


def minutes(angle: Column) -> Column:
    a = F.abs(angle)
    return F.floor(a * F.lit(60.0) - F.floor(a) * F.lit(60)).cast("int")


def seconds(angle: Column) -> Column:
    a = F.abs(angle)
    return F.floor(a * F.lit(3600.0) - F.floor(a) * F.lit(3600) - minutes(angle) * F.lit(60)).cast("int")


def hemisphere(angle: Column, positive: str, negative: str) -> Column:
    return F.when(angle < 0, F.lit(negative)).otherwise(F.lit(positive))


def dms_text(angle: Column, positive: str, negative: str) -> Column:
    """``51.30'05"N`` style text."""
    return F.format_string(
        "%02d.%02d'%02d\"%s", degrees(angle), minutes(angle), seconds(angle), hemisphere(angle, positive, negative)
    )


def dms_tag(angle: Column) -> Column:
    """Degrees, minutes and seconds as three rationals in tag text form."""
    return F.format_string("%d/1 %d/1 %d/1", degrees(angle), minutes(angle), seconds(angle))
