"""New, changed and gone files of a stream of listings.

Each scan of a folder is appended to a table of listings under the next whole number.  The
stream keeps for each path the scan it was last seen in, length, time of change and digest,
in one state for each bucket of paths.  A row that differs from its state is ``changed``; a path without state, or one
that was not in the scan before, is ``new``; a path that a whole scan has passed by is
``gone``, which its bucket finds by the watermark, in the next rows or by a timer.  A second of event time stands for a scan, so
the watermark is the last scan that all tasks have read.

Rewritten files are seen because listings are rows, not file names: the file source reads
each listing once, whatever files it names.  Rows of a scan that a path has passed already
are left out, repeated rows count once, rows without a path are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LISTING = "path string, length long, mtime timestamp, digest string, scan long"
EVENTS = "path string, scan long, change string, length long, mtime timestamp"
_EVENTS = "path string, scan long, change string, length long, micros long"
_STATE = "path array<string>, scan array<long>, length array<long>, micros array<long>, digest array<string>"
#: Paths are dealt to so many states: a call for each path costs more than the path itself.  Fixed by the first start.
BUCKETS = 1024


def append_listing(listing: DataFrame, folder: str, scan: int) -> None:
    """Adds a scan's listing (path, length, mtime and, if known, digest) to the table of listings."""
    digest = F.col("digest") if "digest" in listing.columns else F.lit(None).cast("string")
    rows = listing.select("path", F.col("length").cast("long").alias("length"), F.col("mtime").cast("timestamp").alias("mtime"), digest.alias("digest"), F.lit(scan).cast("long").alias("scan"))
    rows.write.mode("append").parquet(folder)


def listings(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Stream of the table of listings, oldest first."""
    return spark.readStream.schema(LISTING).option("maxFilesPerTrigger", str(per_trigger)).parquet(folder)


def _events(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    out, touched, watermark = [], set(), state.getCurrentWatermarkMs()
    known = {path: tuple(rest) for path, *rest in zip(*state.get)} if state.exists else {}
    if not state.hasTimedOut:
        rows = [r for p in parts for r in zip(p["path"].tolist(), p["scan"].tolist(), p["length"].tolist(), p["micros"].tolist(), p["digest"].tolist())]
        rows.sort(key=itemgetter(1))
        for path, *rest in rows:
            own, last = tuple(None if v is None or v != v else v if isinstance(v, str) else int(v) for v in rest), known.get(path)
            touched.add(path)
            if last is not None and own[0] <= last[0]:
                continue
            if last is not None and last[0] < own[0] - 1:
                out.append((path, last[0] + 1, "gone", last[1], last[2]))
                last = None
            if last is None:
                out.append((path, own[0], "new", own[1], own[2]))
            elif own[1:] != last[1:]:
                out.append((path, own[0], "changed", own[1], own[2]))
            known[path] = own
    # the watermark is past a path's scan when the next one is whole
    for path in [p for p, last in known.items() if last[0] * 1000 < watermark and p not in touched]:
        scan, length, micros, _ = known.pop(path)
        out.append((path, scan + 1, "gone", length, micros))
    if known:
        state.update((list(known), *map(list, zip(*known.values()))))
        state.setTimeoutTimestamp(max(min(last[0] for last in known.values()) * 1000, watermark + 1))
    elif state.exists:
        state.remove()
    if out:
        path, scan, change, length, micros = map(list, zip(*out))
        yield pd.DataFrame({"path": path, "scan": scan, "change": change, "length": pd.array(length, "Int64"), "micros": pd.array(micros, "Int64")})


def changes(stream: DataFrame) -> DataFrame:
    """path, scan, change, length and mtime of each event in a stream of listings."""
    timed = stream.filter("path IS NOT NULL").withColumn("at", F.timestamp_seconds("scan")).withWatermark("at", "0 seconds")
    dealt = timed.withColumns({"bucket": F.pmod(F.xxhash64("path"), F.lit(BUCKETS)), "micros": F.unix_micros("mtime")}).drop("mtime")
    found = dealt.groupBy("bucket").applyInPandasWithState(_events, _EVENTS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("path", "scan", "change", "length", F.timestamp_micros("micros").alias("mtime"))


def track(stream: DataFrame, events: str, checkpoint: str, partitions: int | None = None, once: bool = True) -> StreamingQuery:
    """Appends the events to a table; the checkpoint keeps states and makes that exactly once across restarts.  ``partitions``
    of the state are fixed by the first start."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        w = changes(stream).writeStream.format("parquet").option("path", events).option("checkpointLocation", checkpoint).outputMode("append")
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()
    finally:
        if partitions:
            spark.conf.set("spark.sql.shuffle.partitions", before)
