"""Tag operators on ``tags map<string,string>``: every edit is a narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..functions.templates import template

TAGS = "tags"

# Patterns and names that decide what may be edited or written.
TAG_PATTERN = r"^(Exif|Iptc)_\w+$"
WRITABLE = ["dpi", "transparency", "orientation", "Pexif_Orientation", "Zexif_Orientation"]
READ_ONLY = ["Exif_Photo_PixelXDimension", "Exif_Photo_PixelYDimension", "Exif_Image_Software"]
# Formats that can carry tags when written.
TAG_FORMATS = {"Exif": ["JPEG", "TIFF", "PNG"], "Iptc": ["JPEG", "TIFF"]}
TIME_TAGS = ["Exif_Image_DateTime", "Exif_Photo_DateTimeOriginal", "Exif_Photo_DateTimeDigitized"]
# A vendor tag belongs to a camera maker's own group.
STANDARD_GROUPS = r"^(Exif_(Image|Photo|Iop|GPSInfo|Thumbnail)|Iptc_\w+?)_"


def _without(m: Column, *tags) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*tags))


def tag(name: str) -> Column:
    return F.try_element_at(F.col(TAGS), F.lit(name))


def set_tags(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Set several tags at once; a NULL or blank value deletes the tag."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.trim(v).alias("value")) for k, v in new.items()])
    present = F.filter(entries, lambda s: s["value"].isNotNull() & (s["value"] != ""))
    return df.withColumn(TAGS, F.map_concat(_without(F.col(TAGS), *new), F.map_from_entries(present)))


def write_tag(df: DataFrame, name: str, value: str) -> DataFrame:
    return set_tags(df, {name: template(value, set(df.columns))})


def rename_tag(df: DataFrame, old: str, new: str) -> DataFrame:
    """Move a value to another tag, replacing what that tag held."""
    old, new = old.strip(), new.strip()
    if not old or not new or old == new:
        return df
    moved = F.transform_keys(
        _without(F.col(TAGS), new), lambda k, v: F.when(k == old, F.lit(new)).otherwise(k)
    )
    return df.withColumn(TAGS, F.when(F.map_contains_key(F.col(TAGS), F.lit(old)), moved).otherwise(F.col(TAGS)))


def delete_tags(df: DataFrame, method: str = "All", name: str | None = None) -> DataFrame:
    """``All``, ``Exif``, ``Iptc`` or ``One``."""
    if method == "All":
        keep = F.map_filter(TAGS, lambda k, v: ~k.rlike(TAG_PATTERN))
    elif method in ("Exif", "Iptc"):
        keep = F.map_filter(TAGS, lambda k, v: ~k.startswith(method))
    elif method == "One" and name:
        keep = _without(F.col(TAGS), name)
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.withColumn(TAGS, keep)


def time_shift(
    df: DataFrame, change: str = "Exif and file", use_exif: bool = True, mtime: str = "mtime", **delta
) -> DataFrame:
    """Shift the three date tags, the file time, or both.  The source is the date tag
    when it is there and wanted, else the file time."""
    if change not in ("Exif time", "File time", "Exif and file"):
        raise ValueError(f"unknown change {change!r}")
    start = F.col(mtime)
    if use_exif and change != "File time":
        start = F.coalesce(V.exif_time(tag(TIME_TAGS[0])), start)
    out = df.withColumn("_shifted", V.shift_time(start, **delta))
    if change != "File time":
        out = set_tags(out, {t: V.exif_text(F.col("_shifted")) for t in TIME_TAGS})
    if change != "Exif time":
        out = out.withColumn(mtime, F.col("_shifted"))
    return out.drop("_shifted")


def is_editable(name: Column) -> Column:
    return name.rlike(TAG_PATTERN)


def is_writable(name: Column, fmt: Column | None = None) -> Column:
    ok = name.isin(WRITABLE) | (name.rlike(TAG_PATTERN) & ~name.isin(READ_ONLY))
    if fmt is None:
        return ok
    holds = F.lit(False)
    for group, formats in TAG_FORMATS.items():
        holds = holds | (name.startswith(group + "_") & fmt.isin(formats))
    return ok & (~name.rlike(TAG_PATTERN) | holds)


def write_issues(long: DataFrame, fmt: str = "format") -> DataFrame:
    """An issue for each tag the file's format cannot hold."""
    return long.filter(~is_writable(F.col("tag"), F.col(fmt))).select(
        "image_id", F.lit("write tag").alias("action"), F.lit("warning").alias("severity"),
        F.concat(F.col("tag"), F.lit(" cannot be written to "), F.col(fmt)).alias("message"),
    )


def to_long(df: DataFrame, *keep: str) -> DataFrame:
    """One row per tag."""
    # explode would filter on the map's size first and so compute the map again.
    rows = df.select(*(keep or ("image_id",)), F.explode_outer(TAGS).alias("tag", "value"))
    return rows.filter(F.col("tag").isNotNull())


def to_map(long: DataFrame) -> DataFrame:
    """Back to one row per image.  A tag occurs once per image, so a group is bounded by
    the tag vocabulary."""
    return long.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "value"))).alias(TAGS))


def expand_tags(long: DataFrame) -> DataFrame:
    """Adds rows ``tag.year`` ... for dates, ``tag[i]`` for short tuples and
    ``tag.numerator`` / ``tag.denominator`` for rationals; the plain rows stay."""
    v = F.col("value")
    t = V.exif_time(F.when(v.rlike(V.EXIF_TIME_PATTERN), v))
    date_row = long.withColumn("t", t)

    def part(suffix: str, value: Column) -> Column:
        return F.struct(F.concat("tag", F.lit(suffix)).alias("tag"), value.cast("string").alias("value"))

    dates = F.array(*[part("." + n, F.expr(sql)) for n, sql in V.DATE_PARTS.items()])
    ratio = V.parse_rational(v)
    rationals = F.array(part(".numerator", ratio["num"]), part(".denominator", ratio["den"]))
    words = F.split(v, " ")
    is_tuple = v.rlike(r"^-?\d+(/\d+)?( -?\d+(/\d+)?){1,8}$")
    tuples = F.transform(
        words,
        lambda w, i: F.struct(F.concat("tag", F.lit("["), i, F.lit("]")).alias("tag"), w.alias("value")),
    )
    rows = (
        F.when(F.col("t").isNotNull(), F.concat(F.array(part("", v)), dates))
        .when(ratio.isNotNull() & (ratio["den"] != 1), F.concat(F.array(part("", v)), rationals))
        .when(is_tuple, F.concat(F.array(part("", v)), tuples))
        .otherwise(F.array(part("", v)))
    )
    others = [c for c in long.columns if c not in ("tag", "value")]
    return date_row.select(*others, F.explode_outer(rows).alias("_e")).select(*others, "_e.tag", "_e.value")


def is_vendor(name: Column) -> Column:
    return name.rlike(TAG_PATTERN) & ~name.rlike(STANDARD_GROUPS)


def select_tags(long: DataFrame, group: str = "All", query: str = "") -> DataFrame:
    """Rows of a tag group (``All``, ``Select`` or a prefix such as ``Exif``) whose tag
    holds ``query``; vendor tags are marked so that they sort last."""
    name = F.col("tag")
    if group == "Select":
        long = long.filter(~name.rlike(r"[_#.\[]"))
    elif group != "All":
        long = long.filter(name.startswith(group + "_"))
    return long.filter(F.lower(name).contains(query.lower())).withColumn("vendor", is_vendor(name))


def tag_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """Images x tags from the map form: no shuffle.  A missing tag is ''."""
    return df.select("image_id", *[F.coalesce(tag(n), F.lit("")).alias(n) for n in names])


def tag_pivot(long: DataFrame, names: list[str]) -> DataFrame:
    """The same from the long form, with the wanted tags given up front."""
    wide = long.filter(F.col("tag").isin(names)).groupBy("image_id").pivot("tag", names).agg(F.first("value"))
    return wide.na.fill("", names)


def tag_unpivot(wide: DataFrame) -> DataFrame:
    """Back to long rows; '' cells are absent tags."""
    names = [c for c in wide.columns if c != "image_id"]
    return wide.unpivot("image_id", names, "tag", "value").filter(F.col("value") != "")


def transpose_matrix(long: DataFrame, ids: list[int]) -> DataFrame:
    """Tags x images for the image ids shown."""
    wide = long.filter(F.col("image_id").isin(ids)).groupBy("tag").pivot("image_id", ids).agg(F.first("value"))
    return wide.na.fill("")


def used_tags(long: DataFrame) -> DataFrame:
    """Tags at least one image holds, with their counts; partial counts come first."""
    return long.filter(F.col("value").isNotNull()).groupBy("tag").agg(F.count("*").alias("images"))


def bulk_edit(long: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply ``edits(image_id, tag, value)`` - NULL value deletes - and mark changed cells.
    Keys are unique cells on both sides, so no key is hot."""
    new = edits.select("image_id", "tag", F.col("value").alias("_new"), F.lit(True).alias("_edit"))
    out = long.join(new, ["image_id", "tag"], "full_outer")
    edited = F.coalesce(F.col("_edit"), F.lit(False))
    return (
        out.withColumn("changed", edited & ~F.col("value").eqNullSafe(F.col("_new")))
        .withColumn("value", F.when(edited, F.col("_new")).otherwise(F.col("value")))
        .filter(F.col("value").isNotNull())
        .drop("_new", "_edit")
    )


def rename_key(long: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a tag over all images of the long form; an existing target is replaced."""
    moved = long.filter(F.col("tag") == old).select("image_id", F.lit(new).alias("tag"), "value")
    kept = long.filter(~F.col("tag").isin(old, new))
    held = long.filter(F.col("tag") == new).join(moved.select("image_id"), "image_id", "left_anti")
    return kept.unionByName(held).unionByName(moved)


def write_tags(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The long table and, next to it, path and modification time. What is there is replaced only if ``mode`` says so."""
    to_long(df).write.mode(mode).parquet(f"{path}/tags")
    df.select(*(c for c in ("image_id", "path", "mtime") if c in df.columns)).write.mode(mode).parquet(f"{path}/times")
