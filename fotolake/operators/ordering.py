"""Global and per-group positions without a single-task window.

Rows are range partitioned on the sort keys, sorted inside each partition and written
to the shared folder with partition number and place in it.  Both are stable from then
on, so a position is the partition's start plus the place in it.  A group holding a large
share of the rows is simply spread over several partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .skew import salted_lookup

SLICE = "_slice"
PLACE = "_place"
_PLACE_BITS = 33  # low bits of monotonically_increasing_id hold the row's place


def sliced(df: DataFrame, *keys: Column) -> DataFrame:
    """Range partition and sort by ``keys``; adds the slice number and the place in it."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND((1 << _PLACE_BITS) - 1)
    return written(ranged.withColumns({SLICE: F.spark_partition_id(), PLACE: place}), "sliced")


def slice_starts(df: DataFrame) -> DataFrame:
    """First global position of each slice.  One row per partition, so the ordered
    window and the broadcast are bounded by the partition count."""
    sizes = df.groupBy(SLICE).agg(F.count("*").alias("_n"))
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))


def global_position(df: DataFrame, *keys: Column, name: str = "index") -> DataFrame:
    """0-based position in the total order of ``keys``."""
    s = sliced(df, *keys)
    return (
        s.join(F.broadcast(slice_starts(s)), SLICE)
        .withColumn(name, F.col("_start") + F.col(PLACE))
        .drop(SLICE, PLACE, "_start")
    )


def group_position(df: DataFrame, group: str, *keys: Column, name: str) -> DataFrame:
    """0-based position inside ``group``: global position minus the group's first one.
    The group starts are pre-aggregated and looked up with a salt."""
    g = global_position(df, F.col(group), *keys, name="_pos")
    starts = g.groupBy(group).agg(F.min("_pos").alias("_first"))
    return salted_lookup(g, starts, [group], F.col("_pos")).withColumn(name, (F.col("_pos") - F.col("_first")).cast("int")).drop("_pos", "_first")
