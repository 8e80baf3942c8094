"""Named queries, each next to the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


FILES = """
files AS (
  SELECT doc_id AS file_id,
         '/photos/' || lang || '/' || source || '/' ||
           CASE WHEN doc_id % 2 = 0 THEN 'IMG_' ELSE 'img_' END ||
           lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.' ||
           CASE doc_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'JPG' WHEN 2 THEN 'png' WHEN 3 THEN 'tif' ELSE 'txt' END AS path,
         '/photos' AS root, n_chars AS length,
         TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 97 MINUTE AS mtime
  FROM documents),
existing AS (SELECT DISTINCT doc_id AS file_id FROM labels),
parts AS (
  SELECT *, '/photos/' || split_part(path, '/', 3) || '/' || split_part(path, '/', 4) AS own,
         split_part(path, '/', 5) AS base,
         split_part(split_part(path, '/', 5), '.', 1) AS filename,
         split_part(split_part(path, '/', 5), '.', 2) AS type
  FROM files)
"""

TAGS = """
src AS (SELECT event_id AS image_id, ts AS mtime, event_type, user_id, props FROM events),
tags AS (
  SELECT image_id, 'Exif_Image_DateTime' AS tag, strftime(mtime, '%Y:%m:%d %H:%M:%S') AS value FROM src
  UNION ALL SELECT image_id, 'Exif_Image_Make', event_type FROM src
  UNION ALL SELECT image_id, 'Exif_Image_Artist', 'user ' || CAST(user_id AS VARCHAR) FROM src
  UNION ALL SELECT image_id, 'Exif_Image_Orientation', CAST(image_id % 8 + 1 AS VARCHAR) FROM src
  UNION ALL SELECT image_id, 'Iptc_Application2_Caption', props FROM src WHERE image_id % 3 = 0
  UNION ALL SELECT image_id, 'Exif_Canon_0x0001', CAST(image_id AS VARCHAR) FROM src WHERE event_type = 'error')
"""

GPS = """
shots AS (SELECT event_id AS shot_id, user_id AS camera, ts AS taken FROM events WHERE event_type = 'view'),
track AS (
  SELECT user_id AS camera, ts AS t,
         CAST(arg_max(value, event_id) AS DOUBLE) / 4.0e0 - 40.0e0 AS lat,
         CAST(arg_max(value, event_id) AS DOUBLE) / 2.0e0 - 80.0e0 AS lon,
         CAST(max(event_id) % 400 AS DOUBLE) - 50.0e0 AS ele
  FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
"""

RGBA = """
v AS (
  SELECT vec_id // 4 AS image_id, vec_id % 4 AS band, CAST(i - 1 AS INTEGER) AS k,
         CAST(greatest(0, least(255, floor(CAST(embedding[i] AS DOUBLE) * 240.0e0 + 128.0e0))) AS INTEGER) AS v
  FROM embeddings, range(1, 65) t(i)),
rgba AS (
  SELECT image_id, 8 AS width, 8 AS height, k % 8 AS x, k // 8 AS y,
         max(v) FILTER (band = 0) AS r, max(v) FILTER (band = 1) AS g,
         max(v) FILTER (band = 2) AS b, max(v) FILTER (band = 3) AS a
  FROM v GROUP BY image_id, k),
sprite AS (
  SELECT image_id, width, height, x, y, r, g, b, CASE WHEN r < 96 THEN 0 ELSE a END AS a FROM rgba),
mark AS (SELECT x, y, r, g, b, a FROM rgba WHERE image_id = 0 AND x < 4 AND y < 4)
"""


def with_files(sql: str) -> str:
    return f"WITH {FILES.strip()}{sql}"


def with_tags(sql: str) -> str:
    return f"WITH {TAGS.strip()}{sql}"


def with_gps(sql: str) -> str:
    return f"WITH {GPS.strip()}{sql}"


def with_rgba(sql: str) -> str:
    return f"WITH {RGBA.strip()}{sql}"


def byte(e: str) -> str:
    return f"CAST(greatest(0, least(255, floor({e}))) AS INTEGER)"


def mix(a: str, b: str, amount: float) -> str:
    """Blend at ``amount`` percent."""
    return byte(f"{a} + ({b} - {a}) * {amount / 100.0!r}e0")


def on_top(dst: str, src: str, mask: str) -> str:
    return byte(f"{dst} + ({src} - {dst}) * {mask} / 255.0e0")


LUMA = "CAST(floor((r * 299 + g * 587 + b * 114) / 1000.0e0) AS INTEGER)"
