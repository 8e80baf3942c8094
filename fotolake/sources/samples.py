"""Small real files written by Spark tasks from the raster tables, for round trips
through the file sources (PNG images, GPX tracks)."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F


def png_bytes(pixels: np.ndarray, texts: dict[str, str] | None = None, chunks: list[tuple[bytes, bytes]] = ()) -> bytes:
    """A PNG of an (h, w, 3 or 4) byte array, unfiltered lines."""
    h, w, n = pixels.shape

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    lines = np.concatenate([np.zeros((h, 1), np.uint8), pixels.astype(np.uint8).reshape(h, w * n)], axis=1)
    parts = [b"\x89PNG\r\n\x1a\n", chunk(b"IHDR", head)]
    parts += [chunk(b"tEXt", k.encode() + b"\0" + v.encode()) for k, v in (texts or {}).items()]
    parts += [chunk(n_, b_) for n_, b_ in chunks]
    return b"".join([*parts, chunk(b"IDAT", zlib.compress(lines.tobytes())), chunk(b"IEND", b"")])


def write_files(df: DataFrame, folder: str, encode) -> None:
    """Write one file per row from the tasks: ``encode(row) -> (name, bytes)``.  A task
    that runs again writes the same bytes to the same names."""

    def put(rows):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        for row in rows:
            name, body = encode(row)
            with system.open_output_stream(f"{base}/{name}") as f:
                f.write(body)

    df.foreachPartition(put)


def png_folder(rasters: DataFrame, folder: str, broken_every: int = 0) -> str:
    """``img_<image_id>.png`` for each raster row; every ``broken_every``-th is not an image."""

    def encode(row):
        name = f"img_{row.image_id}.png"
        if broken_every and row.image_id % broken_every == 0:
            return name, b"not an image"
        a = np.array([row.r, row.g, row.b, row.a], np.uint8).T.reshape(row.height, row.width, 4)
        return name, png_bytes(a, {"Title": f"image {row.image_id}"}, [(b"pHYs", struct.pack(">IIB", 2835, 2835, 1))])

    write_files(rasters, folder, encode)
    return folder


def gpx_folder(track: DataFrame, folder: str) -> str:
    """Track points as GPX files through Spark's XML writer."""
    track.select(
        F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "ele", F.col("t").cast("timestamp").alias("time"),
    ).write.format("xml").option("rootTag", "gpx").option("rowTag", "trkpt").option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").save(folder)
    return folder


def image_id_of(path):
    return F.regexp_extract(path, r"img_(\d+)\.png$", 1).cast("long")
