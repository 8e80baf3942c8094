"""Views over the driver tables that stand for photo folders, pixels, tracks and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, path, root, length, mtime - one file per document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    i = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in ("jpg", "JPG", "png", "tif", "txt")]), (i % 5 + 1).cast("int"))
    return d.select(
        i.alias("file_id"),
        F.concat(
            F.lit("/photos/"), "lang", F.lit("/"), "source", F.lit("/"),
            F.when(i % 2 == 0, "IMG_").otherwise("img_"),
            F.lpad(i.cast("string"), 6, "0"), F.lit("."), ext,
        ).alias("path"),
        F.lit("/photos").alias("root"),
        F.col("n_chars").alias("length"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(i * 97).cast("int"))).alias("mtime"),
    )


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id")).distinct()


def _levels(embedding: str = "embedding"):
    return F.transform(
        embedding,
        lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(e.cast("double") * 240.0 + 128.0))).cast("int"),
    )


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, width, height and one array per band: 8x8 images, four vectors each.
    ``vec_id`` is unique, so a group never holds more than four rows.  A band without a
    vector is an array of NULLs."""
    v = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 4).cast("long").alias("image_id"),
        (F.col("vec_id") % 4).alias("band"),
        _levels().alias("v"),
    )
    band = lambda n: F.coalesce(F.max(F.when(F.col("band") == n, F.col("v"))), F.array_repeat(F.lit(None).cast("int"), 64))
    return (
        v.groupBy("image_id")
        .agg(*[band(n).alias(c) for n, c in enumerate("rgba")])
        .select("image_id", F.lit(8).alias("width"), F.lit(8).alias("height"), "r", "g", "b", "a")
    )


def pixels(packed: DataFrame) -> DataFrame:
    """image_id, width, height, x, y, r, g, b, a of 8x8 rasters."""
    return (
        packed
        .select("image_id", "width", "height", F.posexplode_outer(F.arrays_zip("r", "g", "b", "a")).alias("k", "p"))
        .select(
            "image_id", "width", "height",
            (F.col("k") % 8).alias("x"), F.floor(F.col("k") / 8).cast("int").alias("y"),
            "p.r", "p.g", "p.b", "p.a",
        )
    )


def rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel table of ``rasters``."""
    return pixels(rasters(spark, sf_dir))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images without an alpha band."""
    return rgba(spark, sf_dir).withColumn("a", F.lit(None).cast("int"))


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector per image: image_id, width, height, x, y, l."""
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").alias("image_id"), F.posexplode_outer(_levels()).alias("k", "l"))
        .select(
            "image_id", F.lit(8).alias("width"), F.lit(8).alias("height"),
            (F.col("k") % 8).alias("x"), F.floor(F.col("k") / 8).cast("int").alias("y"), "l",
        )
    )


def sprite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transparent where red is below 96."""
    return cut_out(rgba(spark, sf_dir))


def cut_out(px: DataFrame) -> DataFrame:
    return px.withColumn("a", F.when(F.col("r") < 96, 0).otherwise(F.col("a")))


def mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stamp image: the top left 4x4 pixels of image 0."""
    return (
        rgba(spark, sf_dir)
        .filter((F.col("image_id") == 0) & (F.col("x") < 4) & (F.col("y") < 4))
        .select(F.lit(4).alias("width"), F.lit(4).alias("height"), "x", "y", "r", "g", "b", "a")
    )


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("event_type") == "view").select(
        F.col("event_id").alias("shot_id"), F.col("user_id").alias("camera"), F.col("ts").alias("taken")
    )


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """camera, t, lat, lon, ele; of points at one time the highest event counts."""
    last = F.max_by("value", "event_id").cast("double")
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") == "purchase")
        .groupBy(F.col("user_id").alias("camera"), F.col("ts").alias("t"))
        .agg(
            (last / 4.0 - 40.0).alias("lat"),
            (last / 2.0 - 80.0).alias("lon"),
            ((F.max("event_id") % 400).cast("double") - 50.0).alias("ele"),
        )
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, taken and ``tags map<string,string>``; missing tags are absent."""
    e = table(spark, sf_dir, "events")
    tag = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))
    entries = F.array(
        tag("Exif_Image_DateTime", F.date_format("ts", "yyyy:MM:dd HH:mm:ss")),
        tag("Exif_Image_Make", F.col("event_type")),
        tag("Exif_Image_Artist", F.concat(F.lit("user "), F.col("user_id"))),
        tag("Exif_Image_Orientation", F.col("event_id") % 8 + 1),
        tag("Iptc_Application2_Caption", F.when(F.col("event_id") % 3 == 0, F.col("props"))),
        tag("Exif_Canon_0x0001", F.when(F.col("event_type") == "error", F.col("event_id"))),
    )
    present = F.filter(entries, lambda s: s["value"].isNotNull())
    return e.select(
        F.col("event_id").alias("image_id"), F.col("ts").alias("mtime"), F.map_from_entries(present).alias("tags")
    )
