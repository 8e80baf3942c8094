"""Export planning: target paths, collisions, finished work, save modes, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import paths as P
from ..functions.templates import template

# For each target format, the mode a source mode is written as.
SAVE_MODES = {
    "JPEG": {"RGBA": "RGB", "P": "RGB", "LA": "L"},
    "BMP": {"LA": "L", "P": "RGB", "RGBA": "RGB", "YCbCr": "RGB", "CMYK": "RGB"},
    "DIB": {"YCbCr": "RGB", "CMYK": "RGB"},
    "EPS": {"1": "L", "LA": "L", "P": "RGB", "RGBA": "RGB", "YCbCr": "RGB"},
    "GIF": {"1": "P", "L": "P", "LA": "P", "RGB": "P", "RGBA": "P", "CMYK": "P", "YCbCr": "P"},
    "PBM": {"L": "1", "LA": "1", "RGB": "1", "RGBA": "1", "CMYK": "1", "P": "1", "YCbCr": "1"},
    "PCX": {"RGBA": "RGB", "CMYK": "RGB", "YCbCr": "RGB", "LA": "L", "1": "L"},
    "PDF": {"LA": "L", "RGBA": "RGB", "YCbCr": "RGB"},
    "PGM": {"1": "L", "LA": "L", "RGB": "L", "RGBA": "L", "CMYK": "L", "P": "L", "YCbCr": "L"},
    "PPM": {"P": "RGB", "CMYK": "RGB", "YCbCr": "RGB", "LA": "L"},
    "PS": {"1": "L", "LA": "L", "P": "RGB", "RGBA": "RGB", "YCbCr": "RGB"},
    "XBM": {"L": "1", "LA": "1", "RGB": "1", "RGBA": "1", "CMYK": "1", "P": "1", "YCbCr": "1"},
    "TIFF": {"YCbCr": "RGB"},
    "PNG": {"CMYK": "RGB", "YCbCr": "RGB"},
}


def export_plan(
    df: DataFrame,
    name: str = "<filename>",
    folder: str = "<folder>/<subfolder>",
    type: str = "<type>",
) -> DataFrame:
    """Adds ``target`` (NULL when a template reads a missing tag) and its ``format``."""
    v = set(df.columns)
    where, ext = template(folder, v), template(type, v)
    target = F.concat(
        F.regexp_replace(where, "/+$", ""), F.lit("/"), template(name, v), F.lit("."), ext
    )
    return df.withColumn("target", target).withColumn("format", P.image_format(ext))


def template_issues(df: DataFrame, action: str = "save") -> DataFrame:
    """One issue row for each file whose target could not be built."""
    return df.filter(F.col("target").isNull()).select(
        "path", F.lit(action).alias("action"), F.lit("error").alias("severity"),
        F.lit("a name reads a missing value").alias("message"),
    )


def skip_existing(plan: DataFrame, existing: DataFrame, key: str = "target") -> DataFrame:
    """Drops rows whose output is already there.  Place it before any decoding."""
    return plan.join(existing.select(key), key, "left_anti")


def name_collisions(plan: DataFrame) -> DataFrame:
    """Targets more than one source would write, pre-aggregated per target."""
    return (
        plan.filter(F.col("target").isNotNull())
        .groupBy("target")
        .agg(F.count("*").alias("sources"), F.min("path").alias("first_path"))
        .filter(F.col("sources") > 1)
    )


def in_place(plan: DataFrame) -> DataFrame:
    """Rows that would overwrite their own source."""
    return plan.filter(F.col("target") == F.col("path"))


def copy_plan(df: DataFrame, name: str = "<filename>", folder: str = "<folder>") -> DataFrame:
    """Bytes keep their type, so only folder and name are templates."""
    return export_plan(df, name, folder, "<type>").select("path", "target")


rename_plan = copy_plan


def save_mode(df: DataFrame, format: str = "format", mode: str = "mode") -> DataFrame:
    """Adds ``save_mode``: the mode the target format can hold.  The table is fixed and
    small, so it is a map literal and needs no join."""
    table = {f"{f}/{m}": out for f, row in SAVE_MODES.items() for m, out in row.items()}
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    key = F.concat_ws("/", F.col(format), F.col(mode))
    return df.withColumn("save_mode", F.coalesce(F.try_element_at(lookup, key), F.col(mode)))


def mode_issues(df: DataFrame) -> DataFrame:
    return df.filter(F.col("save_mode") != F.col("mode")).select(
        "path", F.lit("save").alias("action"), F.lit("warning").alias("severity"),
        F.concat(F.col("mode"), F.lit(" is saved as "), F.col("save_mode")).alias("message"),
    )


def report(plan: DataFrame) -> DataFrame:
    """One row for each file written."""
    cols = ["target", "filename", "width", "height", "mode", "path"]
    keep = [F.col(c) if c in plan.columns else F.lit(None).cast("string").alias(c) for c in cols]
    return plan.filter(F.col("target").isNotNull()).select(*keep)


def number_issues(issues: DataFrame) -> DataFrame:
    """Issue log with a running number in path order."""
    from .ordering import global_position

    out = global_position(issues, F.col("path"), F.col("action"), F.col("message"), name="_n")
    return out.withColumn("number", F.col("_n") + 1).drop("_n")


def run_summary(report: DataFrame, issues: DataFrame, started=None, finished=None) -> DataFrame:
    """Images written, issues by severity and, when both times are given, seconds."""
    kinds = report.select(F.lit("image").alias("kind")).unionAll(issues.select(F.col("severity").alias("kind")))
    out = kinds.agg(
        F.count_if(F.col("kind") == "image").alias("images"),
        F.count_if(F.col("kind") == "error").alias("errors"),
        F.count_if(F.col("kind") == "warning").alias("warnings"),
    )
    if started is not None and finished is not None:
        out = out.withColumn("seconds", F.lit((finished - started).total_seconds()))
    return out
