"""GPS tracks from GPX files, with or without the GPX namespace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

POINT_SCHEMA = "_lat double, _lon double, ele double, time timestamp"


def read_gpx(spark: SparkSession, paths) -> DataFrame:
    """camera (the file), t, lat, lon, ele.  Of points at one time in a file the largest
    (lat, lon, ele) counts, as the order of rows is not fixed."""
    pts = (
        spark.read.format("xml").option("rowTag", "trkpt").option("ignoreNamespace", "true")
        .schema(POINT_SCHEMA).load(paths)
        .select("*", F.col("_metadata.file_path").alias("camera"))
        .filter(F.col("time").isNotNull() & F.col("_lat").isNotNull())
    )
    point = F.struct(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), F.coalesce("ele", F.lit(0.0)).alias("ele"))
    return pts.groupBy("camera", F.col("time").alias("t")).agg(F.max(point).alias("p")).select("camera", "t", "p.*")


def one_track(points: DataFrame, camera: str = "all") -> DataFrame:
    """All files as one track; a time in two files keeps the point of the later path."""
    point = F.struct("lat", "lon", "ele")
    return (
        points.groupBy("t").agg(F.max_by(point, F.struct("camera", "lat", "lon", "ele")).alias("p"))
        .select(F.lit(camera).alias("camera"), "t", "p.*")
    )
