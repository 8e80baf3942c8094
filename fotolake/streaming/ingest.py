"""Incremental ingest: newly arriving files are appended to a catalog table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import strip_file_scheme
from ..operators.catalog import changed_files
from ..sources.files import BINARY_SCHEMA

# Copied photos keep old times, down to the epoch. The source drops what is this much older than its newest file;
# no time that a file can have is ten thousand years back.
MAX_FILE_AGE = "3650000d"


def new_files(spark: SparkSession, folder: str, glob: str | None = None, per_trigger: int = 100_000) -> DataFrame:
    """Stream of files that appear under ``folder``; bytes are not read."""
    r = (
        spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
        .option("recursiveFileLookup", "true").option("maxFileAge", MAX_FILE_AGE)
        .option("maxFilesPerTrigger", str(per_trigger))
    )
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(folder).select(
        strip_file_scheme(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("mtime"))


def ingest(stream: DataFrame, catalog: str, checkpoint: str, transform=None, once: bool = True) -> StreamingQuery:
    """Append the stream to the Parquet catalog.  The checkpoint makes the append exactly
    once across restarts; ``transform`` adds columns, such as a plan's narrow steps."""
    out = transform(stream) if transform else stream
    w = (
        out.withColumn("read_at", F.current_timestamp()).writeStream.format("parquet")
        .option("checkpointLocation", checkpoint).option("path", catalog).outputMode("append")
    )
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()


def latest(catalog: DataFrame) -> DataFrame:
    """Newest row of each path; partial maxima come before the shuffle."""
    rest = [c for c in catalog.columns if c != "path"]
    return catalog.groupBy("path").agg(
        F.max_by(F.struct(*rest), F.struct("mtime", "read_at")).alias("_r")).select("path", "_r.*")


def rescan(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Changed and new files of a fresh listing.  The file source never re-reads a path
    that was rewritten, so this runs as a scheduled batch."""
    return changed_files(latest(catalog).select("path", "mtime"), listing)
