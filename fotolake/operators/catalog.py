"""File catalog: extension filter, path and stat variables, indexes, folder totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import paths as P
from . import ordering

# Folder names, then file names, sort without case first and by bytes second.


def filter_ext(df: DataFrame, exts: list[str], path: str = "path") -> DataFrame:
    return df.filter(F.lower(P.file_type(F.col(path))).isin([e.lower() for e in exts]))


def path_vars(df: DataFrame, path: str = "path", base: str | None = None) -> DataFrame:
    """Adds folder, root, foldername, subfolder, filename and type.  ``base`` names the
    column holding the folder the scan started from; without it a file's own folder is it."""
    p = F.col(path)
    own = P.folder(p)
    start = F.rtrim(F.col(base), F.lit("/")) if base else own
    return df.withColumns(
        {
            "folder": start,
            "root": P.folder(start),
            "foldername": P.basename(start),
            "subfolder": F.substring(own, F.length(start) + 2, F.length(own)),
            "filename": P.filename(p),
            "type": P.file_type(p),
        }
    )


def stat_vars(df: DataFrame, length: str = "length", mtime: str = "mtime") -> DataFrame:
    """Adds filesize and the date parts of the modification time, 0 where it is unknown."""
    t = F.col(mtime)
    part = lambda f: F.coalesce(f(t), F.lit(0)).cast("int")
    return df.withColumns(
        {
            "filesize": F.coalesce(F.col(length), F.lit(0)).cast("long"),
            "year": part(F.year),
            "month": part(F.month),
            "day": part(F.dayofmonth),
            "hour": part(F.hour),
            "minute": part(F.minute),
            "second": part(F.second),
            "weekday": part(F.weekday),
            "weekdayname": F.date_format(t, "EEEE"),
            "monthname": F.date_format(t, "MMMM"),
        }
    )


def folder_index(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``folderindex``: place of a file in its folder, names compared without case."""
    own = df.withColumn("_folder", P.folder(F.col(path)))
    name = P.basename(F.col(path))
    return ordering.group_position(own, "_folder", F.lower(name), name, name="folderindex").drop("_folder")


def batch_index(df: DataFrame, repeat: int = 1, path: str = "path") -> DataFrame:
    """Adds ``imageindex`` in path order, and for each of ``repeat`` runs ``repeatindex``
    and ``index`` = imageindex * repeat + repeatindex."""
    out = ordering.global_position(df, F.col(path), name="imageindex")
    return repeated(out, repeat)


def repeated(df: DataFrame, repeat: int = 1) -> DataFrame:
    return df.withColumn("repeatindex", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))).withColumn(
        "index", F.col("imageindex") * repeat + F.col("repeatindex")
    )


def indexed(df: DataFrame, path: str = "path", repeat: int = 1) -> DataFrame:
    """Both indexes.  Folder order groups a folder's files, so one more pass gives path order."""
    return batch_index(folder_index(df, path), repeat, path)


def folder_rollup(df: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """Files and bytes of every folder, its subfolders included.  Partial sums per own
    folder come first, so the ancestor rows grow with folders, not files."""
    own = df.groupBy(P.folder(F.col(path)).alias("_folder")).agg(
        F.count("*").alias("_files"), F.sum(length).alias("_bytes")
    )
    parts = F.split(F.col("_folder"), "/")
    ancestors = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"),
    )
    return (
        own.withColumn("folder", F.explode(ancestors))
        .groupBy("folder")
        .agg(F.sum("_files").alias("files"), F.sum("_bytes").alias("bytes"))
        .withColumn("depth", F.size(F.split("folder", "/")) - 1)
    )


def row_search(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which any column holds ``text``, compared without case."""
    cols = [F.col(c).cast("string") for c in (columns or df.columns)]
    return df.filter(F.lower(F.concat_ws(" ", *cols)).contains(text.lower()))


def changed_files(old: DataFrame, new: DataFrame, path: str = "path", mtime: str = "mtime") -> DataFrame:
    """Files that are new or modified since ``old`` was read, with the reason."""
    seen = old.groupBy(path).agg(F.max(mtime).alias("_seen"))
    return (
        new.join(seen, path, "left")
        .withColumn("change", F.when(F.col("_seen").isNull(), "new").when(F.col(mtime) > F.col("_seen"), "modified"))
        .filter(F.col("change").isNotNull())
        .drop("_seen")
    )
