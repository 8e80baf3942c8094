"""What the text operators share: tables, the shared folder, array files, word expressions."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: ASCII white space, as it stands between words.
SPACE = "[\\x20\\x09-\\x0D]"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir; only a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """`written`, and the table's folder, for `removed`."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends here, and executors may be lost."""
    return written_at(df)[0]


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of `written_at` that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The setting for the jobs that run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of fewer rows for the jobs that run inside: rows with long arrays make large ones."""
    return _setting(spark, _BATCH, str(rows))


def shuffles_removed(spark: SparkSession):
    """Each job that runs inside deletes its shuffle files when it ends, not when the driver collects its garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def keep_batches_small(spark: SparkSession, rows: int = 1000) -> None:
    """From now on the session's Arrow batches have no more rows than this: for frames that run after they are returned."""
    if not 0 < int(spark.conf.get(_BATCH)) <= rows:
        spark.conf.set(_BATCH, str(rows))


def with_fields(schema: StructType, *fields: tuple[str, str | DataType]) -> StructType:
    """A new schema; `add` would change the frame's own."""
    out = StructType(list(schema.fields))
    for name, kind in fields:
        out.add(name, kind)
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; `lower` would change other alphabets."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, separators: str = SPACE) -> Column:
    """The words between runs of separators; none for NULL."""
    parts = F.split(F.coalesce(text, F.lit("")), f"{separators}+")
    return F.filter(parts, lambda w: w != "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each row, empty for NULL."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def ranges(lengths: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `size` bytes; one long text makes a range of its own."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        held += n
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def chunks(rows: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    return ranges([len(r) for r in rows], size)


# Array files in the shared folder


def _filesystem(uri: str):
    """None and a path for file: URIs and plain paths; else pyarrow's file system."""
    if uri.startswith("file:"):
        return None, "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return None, uri
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_array(folder: str, name: str, array: np.ndarray) -> None:
    """Writes an array file whole or not at all, so that a task that runs again is harmless."""
    fs, path = _filesystem(folder)
    data = np.ascontiguousarray(array)
    part = f"{path}/{name}.{uuid.uuid4().hex}.part"
    if fs is None:
        os.makedirs(path, exist_ok=True)
        with open(part, "wb") as out:
            np.save(out, data)
        os.replace(part, f"{path}/{name}")
    else:
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(part) as out:
            np.lib.format.write_array(out, data)
        fs.move(part, f"{path}/{name}")


def map_array(folder: str, name: str) -> np.ndarray:
    """The array, memory-mapped; from a store without local paths, a copy in the worker's temp folder is mapped."""
    fs, path = _filesystem(folder)
    if fs is None:
        file = f"{path}/{name}"
    else:
        file = os.path.join(tempfile.gettempdir(), f"{folder.rpartition('/')[2]}-{name}")
        if not os.path.exists(file):
            part = f"{file}.{uuid.uuid4().hex}.part"
            with fs.open_input_stream(f"{path}/{name}") as source, open(part, "wb") as out:
                while block := source.read(1 << 22):
                    out.write(block)
            os.replace(part, file)
    mapped = np.load(file, mmap_mode="r", allow_pickle=False) if os.path.getsize(file) > 128 else np.load(file)
    return mapped.view(np.ndarray)
