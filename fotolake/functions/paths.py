"""Path columns: folder, name, type and image format."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Extensions that share a format; any other extension is its own format.
FORMAT_EXTENSIONS = {
    "JPEG": ["JPG", "JPEG", "JPE"],
    "TIFF": ["TIF", "TIFF"],
    "SVG": ["SVG", "SVGZ"],
}

# Image types that are read and written.
IMAGE_EXTENSIONS = ["bmp", "dib", "gif", "jpe", "jpeg", "jpg", "im", "msp", "pcx",
                    "png", "pbm", "pgm", "ppm", "tif", "tiff", "xbm"]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    """Everything before the last slash."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def filename(path: Column) -> Column:
    """Base name without its last extension; leading dots do not start an extension."""
    base = basename(path)
    stem = F.regexp_extract(base, r"^(\.*[^.].*)\.[^.]*$", 1)
    return F.when(stem == "", base).otherwise(stem)


def file_type(path: Column) -> Column:
    """Extension as written, without the dot."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*\.([^.]*)$", 1)


def image_format(ext: Column) -> Column:
    up = F.upper(F.ltrim(ext, F.lit(".")))
    out = up
    for fmt, exts in FORMAT_EXTENSIONS.items():
        out = F.when(up.isin(exts), F.lit(fmt)).otherwise(out)
    return out


def title_of(path: Column) -> Column:
    """File name in title case with separators as blanks."""
    return F.initcap(F.trim(F.regexp_replace(filename(path), r"[_\-]+", " ")))


def is_url(text: Column) -> Column:
    return F.lower(text).rlike(r"^(http|https|ftp)://")


def strip_file_scheme(text: Column) -> Column:
    """Hadoop and desktop forms of a local URI, ``file:/x`` and ``file:///x``, to ``/x``."""
    return F.regexp_replace(text, r"^file:(//)?(?=/)", "")


def uri_digest(path: Column) -> Column:
    """md5 of the file URI."""
    return F.md5(F.concat(F.lit("file://"), path))
