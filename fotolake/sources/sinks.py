"""Writing results: rasters, reports, and copies of planned files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators.raster.core import pack_strips
from ..session import written


def write_rasters(pixels: DataFrame, path: str, mode: str = "errorifexists", packed: bool = True) -> None:
    """Packed strips (bounded rows) or the pixel table as Parquet, by number of bands."""
    out = pack_strips(pixels) if packed else pixels.withColumn("bands", F.when(F.col("a").isNull(), 3).otherwise(4))
    out.write.mode(mode).partitionBy("bands").parquet(path)


def write_gps_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The geotag report as CSV with its header."""
    report.write.mode(mode).option("header", True).csv(path)


def _location(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _length(uri: str) -> int | None:
    """Bytes of a file; None without one."""
    fs, at = _location(uri)
    info = fs.get_file_info(at)
    return info.size if info.type.name == "File" else None


def _copy(source: str, target: str) -> None:
    a_fs, a = _location(source)
    b_fs, b = _location(target)
    b_fs.create_dir(b.rpartition("/")[0], recursive=True)
    with a_fs.open_input_stream(a) as i, b_fs.open_output_stream(b) as o:
        while block := i.read(1 << 20):
            o.write(block)


def _staged(target: str, job: str, mark: str) -> str:
    """A hidden name next to the target: its own for each job and attempt or source."""
    folder, _, name = target.rpartition("/")
    return f"{folder}/.{job}.{mark}.{name}"


def _each(df: DataFrame, schema: str, work) -> DataFrame:
    """``work(*row)`` for each row of the tasks; the rows it gives."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [work(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n != "length" else pa.int64()) for c, n in zip(columns, names)], names)

    names = [f.split()[0] for f in schema.split(", ")]
    return df.mapInArrow(run, schema)


def apply_copies(plan: DataFrame, move: bool = False, overwrite: bool = False, copy=_copy) -> DataFrame:
    """Copy (or move) each ``path`` of a copy or rename plan to its ``target`` from the tasks; path, target, outcome.

    Each step is a job over a written table, so an attempt that runs again sees what was decided and not its own output:

    1. decide: ``same``, ``missing`` source, ``exists`` already, ``loses`` (another source of that target comes first), ``copied``.
    2. stage: bytes go to a name of the attempt, which is renamed to that of the job when it is whole and as long as its source.
    3. commit: staged files take their targets' names; one that is gone has done so before.
    4. when moving, sources go whose target is whole.

    If a step before the commit fails, staged files are removed and no target was touched."""
    job = uuid.uuid4().hex[:12]
    wanted = plan.filter(F.col("target").isNotNull()).select("path", "target").distinct()
    first = wanted.groupBy("target").agg(F.min("path").alias("first"))

    def decide(path, target, first):
        if path == target:
            return path, target, "same"
        if _length(path) is None:
            return path, target, "missing"
        if not overwrite and _length(target) is not None:
            return path, target, "exists"
        return path, target, "copied" if path == first else "loses"

    decided = written(_each(wanted.join(first, "target").select("path", "target", "first"), "path string, target string, outcome string", decide), "decided")
    todo = decided.filter("outcome = 'copied'").select("path", "target")

    def stage(path, target):
        part, whole = _staged(target, job, uuid.uuid4().hex), _staged(target, job, "whole")
        copy(path, part)
        if _length(part) != _length(path):
            raise OSError(f"{path} changed while it was copied")
        fs, a = _location(part)
        fs.move(a, _location(whole)[1])
        return path, target, _length(whole)

    def commit(path, target, length):
        whole = _staged(target, job, "whole")
        if _length(whole) is not None:
            fs, a = _location(whole)
            fs.move(a, _location(target)[1])
        elif _length(target) != length:
            raise OSError(f"{target}: the staged copy is gone")
        return path, target, length

    def remove(path, target, length):
        if _length(target) == length and _length(path) is not None:
            fs, a = _location(path)
            fs.delete_file(a)
        return path, target, length

    def sweep(folder):
        """What attempts of this job left behind."""
        from pyarrow import fs as afs

        fs, at = _location(folder)
        for info in fs.get_file_info(afs.FileSelector(at, allow_not_found=True)):
            if info.base_name.startswith(f".{job}."):
                fs.delete_file(info.path)
        return (folder,)

    kinds = "path string, target string, length long"
    folders = todo.select(F.regexp_extract("target", "^(.*)/", 1).alias("folder")).distinct()
    try:
        staged = written(_each(todo, kinds, stage), "staged")
        done = written(_each(staged, kinds, commit), "committed")
        if move:
            written(_each(done, kinds, remove), "removed")
    finally:
        _each(folders, "folder string", sweep).count()
    return decided
