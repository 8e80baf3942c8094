"""File scans.  Folders are listed by tasks where tasks can open the store, else by Spark's own
source on any Hadoop filesystem.  File bytes are read only by jobs that need them."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.paths import IMAGE_EXTENSIONS, file_type, strip_file_scheme
from ..session import written

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _glob(exts: list[str]) -> str:
    """A glob for extensions in any case, pushed to the file listing."""
    either = lambda ch: f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ch
    return "*.{" + ",".join("".join(either(ch) for ch in e) for e in exts) + "}"


def binary_files(spark: SparkSession, paths, exts=None, recursive=True, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    pattern = glob or (_glob(exts) if exts else None)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(paths)


# Stores that tasks open by themselves.
OPENED = ("file", "s3", "s3a", "gs", "hdfs", "abfs")
LISTED = "given string, path string, folder boolean, length long, mtime timestamp"
#: Entries of a folder that are listed at a time.
ENTRIES = 5000


def _uri(path: str) -> str:
    return "s3" + path[3:] if path.startswith("s3a://") else path


def _opens(root: str) -> bool:
    """Whether a root can be looked at without Spark, as tasks do it."""
    if "://" not in root or root.startswith("file:"):
        return True
    from pyarrow import fs

    try:
        where, at = fs.FileSystem.from_uri(_uri(root))
        return where.get_file_info(at).type.name != "NotFound"
    except (OSError, ValueError):
        return False


def _entries(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """path, whether it is a folder, length and time of change (microseconds, whole milliseconds as in other listings) of what lies in a folder; of a file, itself."""
    import os

    if "://" not in folder or folder.startswith("file:"):
        local = "/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder
        if os.path.isfile(local):
            s = os.stat(local)
            yield local, False, s.st_size, s.st_mtime_ns // 1_000_000 * 1000
            return
        with os.scandir(local) as found:
            for e in found:
                try:
                    is_folder = e.is_dir(follow_symlinks=False)
                    s = None if is_folder else e.stat()
                except OSError:  # gone meanwhile
                    continue
                if is_folder or e.is_file():
                    yield e.path, is_folder, s.st_size if s else 0, s.st_mtime_ns // 1_000_000 * 1000 if s else 0
        return
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(_uri(folder))
    scheme, _, rest = folder.partition("://")
    host = f"{scheme}://" + (rest.partition("/")[0] if scheme in ("hdfs", "abfs") else "")
    own = where.get_file_info(at)
    for e in [own] if own.type.name == "File" else where.get_file_info(fs.FileSelector(at)):
        yield host + e.path, e.type.name == "Directory", e.size or 0, int((e.mtime_ns or 0) // 1_000_000 * 1000)


def list_tree(spark: SparkSession, roots: list[str], exts: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """given (the root), path, length, mtime of the files under the roots.

    A table of folders is the frontier: tasks list it, the folders they find are the next frontier, until none are left.
    Nothing of a listing comes to the driver but whether there is a next round.  Names that begin with a dot or an
    underscore are left out, as are links to folders."""
    patterns = None if exts is None else ["*." + e.lower() for e in exts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []

        def batch():
            given, path, folder, length, mtime = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(given), pa.array(path), pa.array(folder), pa.array(length, pa.int64()), pa.array(mtime, pa.timestamp("us", "UTC"))], ["given", "path", "folder", "length", "mtime"])

        for b in batches:
            for given, folder in zip(*(c.to_pylist() for c in b.columns)):
                for path, is_folder, length, mtime in _entries(folder):
                    name = path.rpartition("/")[2]
                    if path != folder and name[:1] in "._" or (not is_folder and patterns and not any(fnmatch.fnmatchcase(name.lower(), p) for p in patterns)):
                        continue
                    rows.append((given, path, is_folder, length, mtime))
                    if len(rows) >= ENTRIES:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()

    frontier = spark.createDataFrame([(r, r.rstrip("/")) for r in roots], "given string, path string")
    tables, tasks = [], len(roots)
    while tasks:
        listed = written(frontier.repartition(tasks).mapInArrow(run, LISTED), "listed")
        tables.append(listed.filter("NOT folder").drop("folder"))
        frontier = listed.filter("folder").select("given", "path")
        # many tasks as soon as there are many folders, few while there are few
        tasks = min(frontier.count(), 4 * spark.sparkContext.defaultParallelism) if recursive else 0
    return reduce(DataFrame.unionByName, tables)


def scan_files(spark: SparkSession, paths, exts: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """path, root, length, mtime of the files under ``paths`` (files and folders may be
    mixed).  ``content`` is never selected, so only the listing is read."""
    exts = IMAGE_EXTENSIONS if exts is None else exts
    roots = [paths] if isinstance(paths, str) else list(paths)
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").partition(":")[0]
    scheme = lambda p: p.partition("://")[0] if "://" in p else "file" if p.startswith("file:") else ""
    # a path without a scheme is a task's own only where the default store is local
    if all((scheme(p) in OPENED or (not scheme(p) and default == "file")) and not set("*?[{") & set(p) and _opens(p) for p in roots):
        out = list_tree(spark, roots, exts, recursive).select(strip_file_scheme(F.col("path")).alias("path"), F.regexp_replace("given", "(?<!^)/+$", "").alias("given"), "length", "mtime")
        return _rooted(out)
    out = None
    for p in roots:
        one = binary_files(spark, p, exts, recursive).select(
            strip_file_scheme(F.col("path")).alias("path"), F.lit(p.rstrip("/")).alias("given"),
            "length", F.col("modificationTime").alias("mtime"))
        out = one if out is None else out.unionByName(one)
    return _rooted(out)


def _rooted(out: DataFrame) -> DataFrame:
    # A path given as a single file starts at its own folder.
    is_file = F.col("path").endswith(F.col("given")) & (file_type(F.col("given")) != "")
    given = strip_file_scheme(F.col("given"))
    root = F.when(is_file, F.regexp_extract(given, r"^(.*)/[^/]*$", 1)).otherwise(given)
    return out.withColumn("root", root).drop("given").dropDuplicates(["path"])
