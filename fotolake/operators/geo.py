"""Photos and GPS tracks: forward as-of join, degree texts, tags and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import values as V
from . import ordering, tags as T

POINT = ("t", "lat", "lon", "ele")


def dedupe_track(points: DataFrame, *tie: str) -> DataFrame:
    """One point per (camera, time).  ``tie`` names columns that decide between points
    at the same time, the largest wins."""
    keys = ("camera", "t")
    rest = [c for c in points.columns if c not in keys]
    order = F.struct(*(tie or rest))
    return points.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_p")).select(*keys, "_p.*")


def asof_points(shots: DataFrame, points: DataFrame, direction: str = "forward") -> DataFrame:
    """For each distinct (camera, taken) the first point at or after it, or the camera's
    last point when there is none; ``nearest`` compares that with the point before.

    Times and points are sorted together in range-partitioned slices, so a busy camera
    spreads over many tasks.  Inside a slice a running value carries the next point
    back; what a slice lacks comes from a summary of one row per camera and slice.
    """
    probes = shots.select("camera", F.col("taken").alias("t")).distinct()  # equal times share one answer
    point = F.struct(*POINT)
    marks = points.select("camera", "t", F.lit(1).alias("kind"), point.alias("p"))
    none = F.lit(None).cast(marks.schema["p"].dataType)
    both = probes.select("camera", "t", F.lit(0).alias("kind"), none.alias("p")).unionByName(marks)
    s = ordering.sliced(both, F.col("camera"), F.col("t"), F.col("kind"))

    summary = s.filter("kind = 1").groupBy("camera", ordering.SLICE).agg(
        F.min("p").alias("lo"), F.max("p").alias("hi"))
    cells = s.select("camera", ordering.SLICE).distinct().join(summary, ["camera", ordering.SLICE], "left")
    # At most one row per slice in each camera's window.
    cam = Window.partitionBy("camera")
    by_slice = cam.orderBy(F.desc(ordering.SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    to_slice = cam.orderBy(ordering.SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(
        "camera", ordering.SLICE,
        F.last("lo", ignorenulls=True).over(by_slice).alias("later"),
        F.last("hi", ignorenulls=True).over(to_slice).alias("earlier"),
        F.max("hi").over(cam).alias("final"),
    )
    # A (camera, slice) group is never larger than one slice.
    key = ["camera", ordering.SLICE]
    back = Window.partitionBy(*key).orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = s.withColumn("next", F.last("p", ignorenulls=True).over(back))
    if direction == "nearest":
        found = found.withColumn("prev", F.last("p", ignorenulls=True).over(ahead))
    out = found.filter("kind = 0").join(carried, key)
    nxt = F.coalesce("next", "later")
    if direction == "forward":
        best = F.coalesce(nxt, F.col("final"))
    elif direction == "nearest":
        prv = F.coalesce("prev", "earlier")
        gap = lambda p: F.abs(F.unix_micros(p["t"].cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp")))
        best = F.when(prv.isNull() | (gap(nxt) <= gap(prv)), nxt).otherwise(F.coalesce(prv, nxt))
    else:
        raise ValueError(f"unknown direction {direction!r}")
    return out.select("camera", F.col("t").alias("taken"), best.alias("p"))


# Points that are broadcast at most, and the steps that search a track of so many.
SMALL_TRACK = 1 << 20
STEPS = SMALL_TRACK.bit_length()


def small_tracks(points: DataFrame) -> DataFrame | None:
    """camera and its points in order of time, one array each, to be broadcast; None for more than SMALL_TRACK points in all."""
    if points.limit(SMALL_TRACK + 1).count() > SMALL_TRACK:
        return None
    return F.broadcast(points.groupBy("camera").agg(F.sort_array(F.collect_list(F.struct(*POINT))).alias("_track")))


def _searched(shots: DataFrame, tracks: DataFrame, direction: str) -> DataFrame:
    """shots with ``p``: each searches its camera's array by halves, inside its row; shots are neither sorted nor shuffled."""
    d = shots.join(tracks, "camera", "left")
    start = F.struct(F.lit(0).alias("lo"), F.coalesce(F.size("_track"), F.lit(0)).alias("hi"))

    def half(a, _):
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        todo, below = a["lo"] < a["hi"], F.get("_track", mid)["t"] < F.col("stamp")
        return F.struct(F.when(todo & below, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(todo & ~below, mid).otherwise(a["hi"]).alias("hi"))

    d = d.withColumn("_at", F.explode_outer(F.array(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, half, lambda a: a["lo"]))))
    nxt, prv, last = F.get("_track", F.col("_at")), F.get("_track", F.col("_at") - 1), F.try_element_at("_track", F.lit(-1))
    if direction == "forward":
        best = F.coalesce(nxt, last)
    elif direction == "nearest":
        gap = lambda p: F.abs(F.unix_micros(p["t"].cast("timestamp")) - F.unix_micros(F.col("stamp").cast("timestamp")))
        best = F.when(prv.isNull() | (gap(nxt) <= gap(prv)), nxt).otherwise(F.coalesce(prv, nxt))
    else:
        raise ValueError(f"unknown direction {direction!r}")
    return d.withColumn("p", best).drop("_track", "_at")


def geotag_broadcast(shots: DataFrame, points: DataFrame, shift: int = 0, direction: str = "forward") -> DataFrame:
    """``geotag`` by searching broadcast tracks where counting finds them small enough, else as it is."""
    tracks = small_tracks(points)
    if tracks is None:
        return geotag(shots, points, shift, direction)
    s = shots.withColumn("stamp", F.col("taken") + F.make_dt_interval(secs=F.lit(shift)))
    return _tagged(_searched(s, tracks, direction))


def _tagged(found: DataFrame) -> DataFrame:
    return found.select("shot_id", "camera", "taken", "stamp", F.col("p.t").alias("gps_time"), "p.lat", "p.lon", "p.ele")


def geotag(shots: DataFrame, points: DataFrame, shift: int = 0, direction: str = "forward") -> DataFrame:
    """Adds the point of each shot (gps_time, lat, lon, ele), NULL for a camera without a
    track.  ``shift`` seconds are added to the camera's clock first."""
    s = shots.withColumn("stamp", F.col("taken") + F.make_dt_interval(secs=F.lit(shift)))
    found = asof_points(s.select("camera", F.col("stamp").alias("taken")), points, direction)
    found = found.select("camera", F.col("taken").alias("stamp"), "p")
    return _tagged(s.join(found, ["camera", "stamp"], "left"))


def gps_tags(tagged: DataFrame) -> DataFrame:
    """Long rows of the GPS tags."""
    lat, lon, ele, t = (F.col(c) for c in ("lat", "lon", "ele", "gps_time"))
    g = "Exif_GPSInfo_"
    values = {
        g + "GPSAltitude": F.format_string("%d/10", F.floor(F.abs(ele) * 10.0)),
        g + "GPSAltitudeRef": F.when(ele < 0, "1").otherwise("0"),
        g + "GPSDateStamp": F.date_format("stamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        g + "GPSLatitude": V.dms_tag(lat),
        g + "GPSLatitudeRef": V.hemisphere(lat, "N", "S"),
        g + "GPSLongitude": V.dms_tag(lon),
        g + "GPSLongitudeRef": V.hemisphere(lon, "E", "W"),
        g + "GPSMapDatum": F.lit("WGS-84"),
        g + "GPSProcessingMethod": F.lit("65 83 67 73 73 0 0 0 72 89 66 82 73 68 45 70 73 88"),
        g + "GPSTimeStamp": F.format_string("%d/1 %d/1 %d/1", F.hour(t), F.minute(t), F.second(t)),
        g + "GPSVersionID": F.lit("2 2 0 0"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("tag"), v.alias("value")) for k, v in values.items()])
    return tagged.filter(lat.isNotNull()).select("shot_id", F.explode(rows).alias("_e")).select("shot_id", "_e.*")


def gps_report(tagged: DataFrame, photofile: str = "shot_id") -> DataFrame:
    """The report rows; write them with ``df.write.csv(path, header=True)``."""
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    return tagged.filter(F.col("lat").isNotNull()).select(
        F.date_format("stamp", iso).alias("camera time"),
        F.date_format("gps_time", iso).alias("nearest gps"),
        V.dms_text(F.col("lat"), "N", "S").alias("latitude"),
        V.dms_text(F.col("lon"), "E", "W").alias("longitude"),
        F.format_string("%6.1f", F.col("ele")).alias("elev"),
        F.col(photofile).cast("string").alias("photofile"),
    )
