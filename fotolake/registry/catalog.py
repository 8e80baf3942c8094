"""Catalog, export, tag and geotag queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P, units as U, values as V
from ..functions.templates import template
from ..operators import catalog as C, export as E, geo as G, tags as T
from ..sources import fixtures as X
from .base import query, with_files, with_gps, with_tags

IMAGES = ["jpg", "png", "tif"]


def _catalog(spark, sf):
    df = C.filter_ext(X.files(spark, sf), IMAGES)
    return C.stat_vars(C.path_vars(df, base="root"))


@query("filter_ext", with_files(" SELECT file_id, path, length FROM parts WHERE lower(type) IN ('jpg', 'png', 'tif')"))
def _(spark, sf):
    return C.filter_ext(X.files(spark, sf), IMAGES).select("file_id", "path", "length")


@query("path_vars", with_files("""
SELECT file_id, '/photos' AS folder, '' AS root, 'photos' AS foldername,
       split_part(path, '/', 3) || '/' || split_part(path, '/', 4) AS subfolder, filename, type
FROM parts"""))
def _(spark, sf):
    return C.path_vars(X.files(spark, sf), base="root").select(
        "file_id", "folder", "root", "foldername", "subfolder", "filename", "type")


@query("stat_vars", with_files("""
SELECT file_id, CAST(length AS BIGINT) AS filesize, CAST(year(mtime) AS INTEGER) AS year,
       CAST(month(mtime) AS INTEGER) AS month, CAST(day(mtime) AS INTEGER) AS day,
       CAST(hour(mtime) AS INTEGER) AS hour, CAST(minute(mtime) AS INTEGER) AS minute,
       CAST(second(mtime) AS INTEGER) AS second, CAST(isodow(mtime) - 1 AS INTEGER) AS weekday,
       dayname(mtime) AS weekdayname, monthname(mtime) AS monthname
FROM files"""))
def _(spark, sf):
    return C.stat_vars(X.files(spark, sf)).select(
        "file_id", "filesize", "year", "month", "day", "hour", "minute", "second",
        "weekday", "weekdayname", "monthname")


@query("folder_index", with_files("""
SELECT file_id, path,
       CAST(row_number() OVER (PARTITION BY own ORDER BY lower(base), base) - 1 AS INTEGER) AS folderindex
FROM parts WHERE lower(type) IN ('jpg', 'png', 'tif')"""))
def _(spark, sf):
    return C.folder_index(C.filter_ext(X.files(spark, sf), IMAGES)).select("file_id", "path", "folderindex")


@query("batch_index_repeat", with_files("""
, i AS (SELECT file_id, path, row_number() OVER (ORDER BY path) - 1 AS imageindex FROM files)
SELECT file_id, imageindex, CAST(r AS INTEGER) AS repeatindex, imageindex * 3 + r AS index
FROM i, range(0, 3) t(r)"""))
def _(spark, sf):
    return C.batch_index(X.files(spark, sf), repeat=3).select("file_id", "imageindex", "repeatindex", "index")


@query("folder_rollup", with_files("""
, a AS (
  SELECT '/photos' AS folder, 1 AS depth, length FROM files
  UNION ALL SELECT '/photos/' || split_part(path, '/', 3), 2, length FROM files
  UNION ALL SELECT own, 3, length FROM parts)
SELECT folder, CAST(depth AS INTEGER) AS depth, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes
FROM a GROUP BY folder, depth"""))
def _(spark, sf):
    return C.folder_rollup(X.files(spark, sf)).select("folder", "depth", "files", "bytes")


@query("row_search", with_files("""
SELECT file_id, path FROM files
WHERE contains(lower(concat_ws(' ', CAST(file_id AS VARCHAR), path)), '/en/src1')"""))
def _(spark, sf):
    return C.row_search(X.files(spark, sf).select("file_id", "path"), "/EN/src1")


@query("changed_files", with_files("""
, old AS (SELECT path, mtime - CASE WHEN file_id % 7 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS seen
          FROM files WHERE file_id % 11 <> 0)
SELECT f.file_id, f.path, CASE WHEN o.seen IS NULL THEN 'new' ELSE 'modified' END AS change
FROM files f LEFT JOIN old o ON f.path = o.path WHERE o.seen IS NULL OR f.mtime > o.seen"""))
def _(spark, sf):
    now = X.files(spark, sf)
    day = F.when(F.col("file_id") % 7 == 0, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day"))
    old = now.filter(F.col("file_id") % 11 != 0).withColumn("mtime", F.col("mtime") - day)
    return C.changed_files(old, now).select("file_id", "path", "change")


_PLAN_SQL = """
, img AS (SELECT * FROM parts WHERE lower(type) IN ('jpg', 'png', 'tif')),
idx AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS index,
               row_number() OVER (PARTITION BY own ORDER BY lower(base), base) - 1 AS folderindex FROM img),
plan AS (
  SELECT *, '/out/' || split_part(path, '/', 3) || '/' || split_part(path, '/', 4) || '/' || CAST(year(mtime) AS VARCHAR) || '-' ||
         lpad(CAST(month(mtime) AS VARCHAR), 2, '0') || '-' || lpad(CAST(day(mtime) AS VARCHAR), 2, '0') || '_' ||
         CASE WHEN index + 1 < 1000 THEN lpad(CAST(index + 1 AS VARCHAR), 3, '0') ELSE CAST(index + 1 AS VARCHAR) END ||
         '.' || lower(type) AS target,
         CASE lower(type) WHEN 'jpg' THEN 'JPEG' WHEN 'tif' THEN 'TIFF' ELSE 'PNG' END AS format
  FROM idx)
"""
NAME = "<year>-<##month>-<##day>_<###(index+1)>"


def _plan(spark, sf):
    df = C.stat_vars(C.path_vars(C.filter_ext(X.files(spark, sf), IMAGES), base="root"))
    df = C.indexed(df)
    return E.export_plan(df, NAME, "/out/<subfolder>", "<type.lower()>")


@query("export_plan", with_files(_PLAN_SQL + """
SELECT file_id, path, target, format, CAST(folderindex AS INTEGER) AS folderindex, index
FROM plan WHERE file_id NOT IN (SELECT file_id FROM existing)"""))
def export_plan_query(spark, sf):
    todo = E.skip_existing(_plan(spark, sf), X.existing(spark, sf), "file_id")
    return todo.select("file_id", "path", "target", "format", "folderindex", "index")


@query("skip_existing", with_files("""
SELECT file_id, path FROM files WHERE file_id NOT IN (SELECT file_id FROM existing)"""))
def _(spark, sf):
    return E.skip_existing(X.files(spark, sf), X.existing(spark, sf), "file_id").select("file_id", "path")


@query("name_collisions", with_files("""
, plan AS (SELECT path, '/flat/' || CAST(year(mtime) AS VARCHAR) || lpad(CAST(month(mtime) AS VARCHAR), 2, '0')
                  || lpad(CAST(day(mtime) AS VARCHAR), 2, '0') || '.' || lower(type) AS target FROM parts)
SELECT target, count(*) AS sources, min(path) AS first_path FROM plan GROUP BY target HAVING count(*) > 1"""))
def _(spark, sf):
    df = C.stat_vars(C.path_vars(X.files(spark, sf)))
    return E.name_collisions(E.export_plan(df, "<year><##month><##day>", "/flat", "<lower(type)>"))


@query("copy_plan", with_files("""
SELECT path, '/copies/' || split_part(path, '/', 4) || '/' || upper(filename) || '_copy.' || type AS target FROM parts"""))
def _(spark, sf):
    return E.copy_plan(C.path_vars(X.files(spark, sf)), "<filename.upper()>_copy", "/copies/<foldername>")


@query("rename_plan", with_files("""
SELECT path, own || '/' || CAST(length // 1000 AS VARCHAR) || 'k_' || CAST(abs(2 - length) AS VARCHAR) || '.' || type AS target
FROM parts"""))
def _(spark, sf):
    df = C.stat_vars(C.path_vars(X.files(spark, sf)))
    return E.rename_plan(df, "<filesize//1000>k_<abs(2-filesize)>", "<folder>")


@query("save_mode", with_files("""
, m AS (SELECT file_id, path, upper(type) AS ext,
               CASE file_id % 4 WHEN 0 THEN 'RGBA' WHEN 1 THEN 'LA' WHEN 2 THEN 'CMYK' ELSE 'RGB' END AS mode FROM parts),
f AS (SELECT *, CASE ext WHEN 'JPG' THEN 'JPEG' WHEN 'TIF' THEN 'TIFF' ELSE ext END AS format FROM m)
SELECT file_id, format, mode,
  CASE WHEN format = 'JPEG' AND mode = 'RGBA' THEN 'RGB' WHEN format = 'JPEG' AND mode = 'LA' THEN 'L'
       WHEN format = 'PNG' AND mode = 'CMYK' THEN 'RGB' ELSE mode END AS save_mode
FROM f"""))
def _(spark, sf):
    modes = F.array(*[F.lit(m) for m in ("RGBA", "LA", "CMYK", "RGB")])
    df = C.path_vars(X.files(spark, sf)).withColumn("format", P.image_format(F.col("type")))
    df = df.withColumn("mode", F.element_at(modes, (F.col("file_id") % 4 + 1).cast("int")))
    return E.save_mode(df).select("file_id", "format", "mode", "save_mode")


@query("run_summary", with_files("""
, m AS (SELECT p.*, e.file_id IS NULL AS todo FROM parts p LEFT JOIN existing e ON p.file_id = e.file_id)
SELECT count(*) FILTER (todo) AS images, CAST(0 AS BIGINT) AS errors,
       count(*) FILTER (todo AND lower(type) = 'jpg') AS warnings FROM m"""))
def _(spark, sf):
    df = E.skip_existing(C.path_vars(X.files(spark, sf)), X.existing(spark, sf), "file_id")
    plan = E.export_plan(df, folder="/out").withColumns(
        {"mode": F.lit("RGBA"), "width": F.lit(8), "height": F.lit(8)})
    issues = E.mode_issues(E.save_mode(plan)).unionByName(E.template_issues(plan))
    return E.run_summary(E.report(plan), issues)


@query("report", with_files("""
SELECT '/out/' || filename || '.png' AS target, filename, 8 AS width, 8 AS height, 'RGBA' AS mode, path FROM parts"""))
def _(spark, sf):
    df = C.path_vars(X.files(spark, sf)).withColumns(
        {"mode": F.lit("RGBA"), "width": F.lit(8), "height": F.lit(8)})
    return E.report(E.export_plan(df, folder="/out", type="png"))


@query("issue_log", with_files("""
, i AS (SELECT path, 'save' AS action, 'warning' AS severity, 'RGBA is saved as RGB' AS message
        FROM parts WHERE lower(type) = 'jpg')
SELECT row_number() OVER (ORDER BY path) AS number, path, action, severity, message FROM i"""))
def _(spark, sf):
    df = C.path_vars(X.files(spark, sf))
    df = df.withColumn("format", P.image_format(F.col("type"))).withColumn("mode", F.lit("RGBA"))
    return E.number_issues(E.mode_issues(E.save_mode(df)))


@query("length_px", with_files("""
, v AS (SELECT file_id, CASE file_id % 8
   WHEN 0 THEN 5.0e0 * (CAST(length AS DOUBLE) / 100.0e0) WHEN 1 THEN -5.0e0 * (CAST(length AS DOUBLE) / 100.0e0)
   WHEN 2 THEN 2.0e0 * (72.0e0 / 2.54e0) WHEN 3 THEN 72.0e0 WHEN 4 THEN 10.0e0
   WHEN 5 THEN 50.0e0 * (CAST(length AS DOUBLE) / 100.0e0) - 10.0e0
   WHEN 6 THEN 2.0e0 * (72.0e0 / 2.54e0) ELSE floor(length / 2.0e0) END AS v FROM files)
SELECT file_id, CAST(CASE WHEN v < 0 THEN -floor(-v + 0.5e0) ELSE floor(v + 0.5e0) END AS BIGINT) AS px FROM v"""))
def _(spark, sf):
    half = F.concat(F.col("length").cast("string"), F.lit("/2 px"))
    sizes = F.array(*[F.lit(s) for s in ("5%", "-5%", "2 cm", "1 inch", "10px", "50% - 10px", "2*1cm")], half)
    text = F.element_at(sizes, (F.col("file_id") % 8 + 1).cast("int"))
    return X.files(spark, sf).select("file_id", U.length_px(text, F.col("length")).alias("px"))


@query("size_bytes", with_files("""
SELECT file_id, CAST(file_id * CASE file_id % 4 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 WHEN 2 THEN 1 ELSE 1073741824 END AS BIGINT) AS bytes
FROM files"""))
def _(spark, sf):
    units = F.array(*[F.lit(s) for s in ("kb", "mb", "bt", "gb")])
    text = F.concat(F.col("file_id").cast("string"), F.element_at(units, (F.col("file_id") % 4 + 1).cast("int")))
    return X.files(spark, sf).select("file_id", U.size_bytes(text).alias("bytes"))


@query("placement", with_files("""
, s AS (SELECT file_id, length AS w, length + 37 AS h FROM files)
SELECT file_id,
  CAST(floor(50.0e0 * (w / 100.0e0) + 0.5e0) + floor(-11 / 2.0e0) AS BIGINT) AS x, CAST(h - 10 - 7 AS BIGINT) AS y,
  CAST(CASE WHEN 800.0e0 / w < 600.0e0 / h THEN 800 ELSE greatest(1, floor(w * (600.0e0 / h) + 0.5e0)) END AS BIGINT) AS fit_w,
  CAST(CASE WHEN 800.0e0 / w < 600.0e0 / h THEN greatest(1, floor(h * (800.0e0 / w) + 0.5e0)) ELSE 600 END AS BIGINT) AS fit_h
FROM s"""))
def _(spark, sf):
    w, h = F.col("length"), F.col("length") + 37
    fw, fh = U.fit_inside(w, h, 800, 600)
    return X.files(spark, sf).select(
        "file_id",
        U.place(U.length_px("50%", w), "Middle", w, 11).alias("x"),
        U.place(F.lit(-10), "Bottom", h, 7).alias("y"),
        fw.alias("fit_w"), fh.alias("fit_h"))


@query("template_functions", with_files("""
SELECT file_id, '2_1' AS a, upper(filename) || ' ' || CAST(greatest(length, 100) AS VARCHAR) || ' px' AS b,
       lpad(CAST(file_id % 1000 AS VARCHAR), 4, '0') AS c, md5('file://' || path) AS uri FROM parts"""))
def _(spark, sf):
    df = C.path_vars(X.files(spark, sf))
    v = set(df.columns)
    return df.select(
        "file_id", template("<1+1>_<int(abs(1-2))>", v).alias("a"),
        template("<filename.upper()> <max(length, 100)> px", v).alias("b"),
        template("<####(file_id % 1000)>", v).alias("c"), P.uri_digest(F.col("path")).alias("uri"))


# ---- tags ----

def _images(spark, sf):
    return X.images(spark, sf)


@query("tags_long", with_tags(" SELECT image_id, tag, value FROM tags"))
def _(spark, sf):
    return T.to_long(_images(spark, sf))


@query("write_tag", with_tags("""
SELECT * FROM tags WHERE tag <> 'Exif_Image_Copyright'
UNION ALL SELECT image_id, 'Exif_Image_Copyright', value || ' (c)' FROM tags WHERE tag = 'Exif_Image_Artist'"""))
def _(spark, sf):
    return T.to_long(T.write_tag(_images(spark, sf), "Exif_Image_Copyright", "<Exif_Image_Artist> (c)"))


@query("rename_tag", with_tags("""
SELECT image_id, CASE WHEN tag = 'Iptc_Application2_Caption' THEN 'Exif_Image_ImageDescription' ELSE tag END AS tag, value
FROM tags"""))
def _(spark, sf):
    return T.to_long(T.rename_tag(_images(spark, sf), "Iptc_Application2_Caption", "Exif_Image_ImageDescription"))


@query("rename_key", with_tags("""
SELECT image_id, CASE WHEN tag = 'Exif_Canon_0x0001' THEN 'Exif_Image_Make' ELSE tag END AS tag, value FROM tags
WHERE NOT (tag = 'Exif_Image_Make' AND image_id IN (SELECT image_id FROM tags WHERE tag = 'Exif_Canon_0x0001'))"""))
def _(spark, sf):
    return T.rename_key(T.to_long(_images(spark, sf)), "Exif_Canon_0x0001", "Exif_Image_Make")


for _method, _cond in (("All", "FALSE"), ("Exif", "NOT starts_with(tag, 'Exif')"), ("One", "tag <> 'Exif_Image_Make'")):

    @query(f"delete_tags_{_method.lower()}", with_tags(f" SELECT * FROM tags WHERE {_cond}"))
    def _(spark, sf, method=_method):
        return T.to_long(T.delete_tags(_images(spark, sf), method, "Exif_Image_Make"))


@query("delete_tags", with_tags(" SELECT * FROM tags WHERE NOT starts_with(tag, 'Iptc')"))
def _(spark, sf):
    return T.to_long(T.delete_tags(_images(spark, sf), "Iptc"))


@query("expand_tags", with_tags("""
, d AS (SELECT image_id, tag, strptime(value, '%Y:%m:%d %H:%M:%S') AS t FROM tags WHERE tag = 'Exif_Image_DateTime')
SELECT * FROM tags
UNION ALL SELECT image_id, tag || '.year', CAST(year(t) AS VARCHAR) FROM d
UNION ALL SELECT image_id, tag || '.month', CAST(month(t) AS VARCHAR) FROM d
UNION ALL SELECT image_id, tag || '.day', CAST(day(t) AS VARCHAR) FROM d
UNION ALL SELECT image_id, tag || '.hour', CAST(hour(t) AS VARCHAR) FROM d
UNION ALL SELECT image_id, tag || '.minute', CAST(minute(t) AS VARCHAR) FROM d
UNION ALL SELECT image_id, tag || '.second', CAST(second(t) AS VARCHAR) FROM d
UNION ALL SELECT image_id, tag || '.weekday', CAST(isodow(t) - 1 AS VARCHAR) FROM d
UNION ALL SELECT image_id, tag || '.weekdayname', dayname(t) FROM d
UNION ALL SELECT image_id, tag || '.monthname', monthname(t) FROM d"""))
def _(spark, sf):
    return T.expand_tags(T.to_long(_images(spark, sf)))


NAMES = ["Exif_Image_Make", "Exif_Image_Artist", "Iptc_Application2_Caption", "Exif_Canon_0x0001"]
_WIDE = "SELECT image_id, " + ", ".join(
    f"coalesce(max(value) FILTER (tag = '{n}'), '') AS \"{n}\"" for n in NAMES) + " FROM tags GROUP BY image_id"


@query("tag_matrix", with_tags(" " + _WIDE))
def _(spark, sf):
    return T.tag_matrix(_images(spark, sf), NAMES)


@query("tag_pivot", with_tags(" " + _WIDE))
def _(spark, sf):
    return T.tag_pivot(T.to_long(_images(spark, sf)), NAMES)


@query("tag_unpivot", with_tags(" SELECT * FROM tags WHERE tag IN (" + ", ".join(f"'{n}'" for n in NAMES) + ")"))
def _(spark, sf):
    return T.tag_unpivot(T.tag_matrix(_images(spark, sf), NAMES))


@query("used_tags", with_tags(" SELECT tag, count(*) AS images FROM tags GROUP BY tag"))
def _(spark, sf):
    return T.used_tags(T.to_long(_images(spark, sf)))


@query("select_tags", with_tags("""
SELECT image_id, tag, value, tag = 'Exif_Canon_0x0001' AS vendor FROM tags
WHERE starts_with(tag, 'Exif_') AND contains(lower(tag), 'a')"""))
def _(spark, sf):
    return T.select_tags(T.to_long(_images(spark, sf)), "Exif", "A")


@query("bulk_edit", with_tags("""
, edits AS (SELECT image_id, 'Exif_Image_Make' AS tag, CASE WHEN image_id % 2 = 0 THEN 'view' END AS value FROM src),
j AS (SELECT t.image_id, t.tag, CASE WHEN e.tag IS NULL THEN t.value ELSE e.value END AS value,
             e.tag IS NOT NULL AND t.value IS DISTINCT FROM e.value AS changed
      FROM tags t LEFT JOIN edits e ON t.image_id = e.image_id AND t.tag = e.tag)
SELECT * FROM j WHERE value IS NOT NULL"""))
def _(spark, sf):
    img = _images(spark, sf)
    edits = img.select("image_id", F.lit("Exif_Image_Make").alias("tag"),
                       F.when(F.col("image_id") % 2 == 0, "view").alias("value"))
    return T.bulk_edit(T.to_long(img), edits)


@query("tag_issues", with_tags("""
, f AS (SELECT *, CASE WHEN image_id % 2 = 0 THEN 'JPEG' ELSE 'PNG' END AS format FROM tags)
SELECT image_id, 'write tag' AS action, 'warning' AS severity, tag || ' cannot be written to PNG' AS message
FROM f WHERE format = 'PNG' AND starts_with(tag, 'Iptc_')"""))
def _(spark, sf):
    fmt = F.when(F.col("image_id") % 2 == 0, "JPEG").otherwise("PNG")
    return T.write_issues(T.to_long(_images(spark, sf)).withColumn("format", fmt))


_SHIFTED = "date_trunc('second', mtime) + INTERVAL 13 MONTH - INTERVAL 3 DAY + INTERVAL 90 MINUTE"


@query("time_shift", with_tags(f"""
, s AS (SELECT image_id, strftime({_SHIFTED}, '%Y:%m:%d %H:%M:%S') AS value FROM src)
SELECT * FROM tags WHERE tag <> 'Exif_Image_DateTime'
UNION ALL SELECT image_id, t, value FROM s, (VALUES ('Exif_Image_DateTime'), ('Exif_Photo_DateTimeOriginal'), ('Exif_Photo_DateTimeDigitized')) v(t)"""))
def _(spark, sf):
    return T.to_long(T.time_shift(_images(spark, sf), years=1, months=1, days=-3, minutes=90))


# ---- geotags ----

_ASOF = """
, hit AS (
  SELECT s.shot_id, s.camera, s.taken, s.taken + INTERVAL 60 SECOND AS stamp,
         coalesce((SELECT min(t) FROM track p WHERE p.camera = s.camera AND p.t >= s.taken + INTERVAL 60 SECOND),
                  (SELECT max(t) FROM track p WHERE p.camera = s.camera)) AS gps_time
  FROM shots s),
tagged AS (SELECT h.*, p.lat, p.lon, p.ele FROM hit h LEFT JOIN track p ON p.camera = h.camera AND p.t = h.gps_time)
"""


@query("geotag", with_gps(_ASOF + " SELECT * FROM tagged"))
def geotag_query(spark, sf):
    return G.geotag(X.shots(spark, sf), X.track(spark, sf), shift=60)


@query("geotag_broadcast", with_gps(_ASOF + " SELECT * FROM tagged"))
def _(spark, sf):
    return G.geotag_broadcast(X.shots(spark, sf), X.track(spark, sf), shift=60)


@query("geotag_nearest", with_gps("""
, c AS (
  SELECT s.shot_id, s.camera, s.taken,
         (SELECT min(t) FROM track p WHERE p.camera = s.camera AND p.t >= s.taken) AS nx,
         (SELECT max(t) FROM track p WHERE p.camera = s.camera AND p.t <= s.taken) AS pv
  FROM shots s),
h AS (SELECT *, CASE WHEN pv IS NULL OR (nx IS NOT NULL AND epoch_us(nx) - epoch_us(taken) <= epoch_us(taken) - epoch_us(pv)) THEN nx ELSE pv END AS gps_time FROM c)
SELECT h.shot_id, h.camera, h.gps_time, p.lat, p.lon FROM h LEFT JOIN track p ON p.camera = h.camera AND p.t = h.gps_time"""))
def _(spark, sf):
    return G.geotag(X.shots(spark, sf), X.track(spark, sf), direction="nearest").select(
        "shot_id", "camera", "gps_time", "lat", "lon")


_DMS = ("format('{{:02d}}.{{:02d}}''{{:02d}}\"{{}}', CAST(floor(abs({c})) AS INTEGER), "
        "CAST(floor(abs({c}) * 60.0e0 - floor(abs({c})) * 60) AS INTEGER), "
        "CAST(floor(abs({c}) * 3600.0e0 - floor(abs({c})) * 3600 - floor(abs({c}) * 60.0e0 - floor(abs({c})) * 60) * 60) AS INTEGER), "
        "CASE WHEN {c} < 0 THEN '{n}' ELSE '{p}' END)")


@query("gps_report", with_gps(_ASOF + f"""
SELECT strftime(stamp, '%Y-%m-%dT%H:%M:%SZ') AS "camera time", strftime(gps_time, '%Y-%m-%dT%H:%M:%SZ') AS "nearest gps",
       {_DMS.format(c='lat', p='N', n='S')} AS latitude, {_DMS.format(c='lon', p='E', n='W')} AS longitude,
       printf('%6.1f', ele) AS elev, CAST(shot_id AS VARCHAR) AS photofile
FROM tagged WHERE lat IS NOT NULL"""))
def _(spark, sf):
    return G.gps_report(geotag_query(spark, sf))


def _dms_tag(c):
    return (f"CAST(CAST(floor(abs({c})) AS INTEGER) AS VARCHAR) || '/1 ' || "
            f"CAST(CAST(floor(abs({c}) * 60.0e0 - floor(abs({c})) * 60) AS INTEGER) AS VARCHAR) || '/1 ' || "
            f"CAST(CAST(floor(abs({c}) * 3600.0e0 - floor(abs({c})) * 3600 - floor(abs({c}) * 60.0e0 - floor(abs({c})) * 60) * 60) AS INTEGER) AS VARCHAR) || '/1'")


@query("gps_tags", with_gps(_ASOF + f"""
, w AS (SELECT shot_id, unnest([
  struct_pack(k := 'GPSAltitude', v := CAST(CAST(floor(abs(ele) * 10.0e0) AS BIGINT) AS VARCHAR) || '/10'),
  struct_pack(k := 'GPSAltitudeRef', v := CASE WHEN ele < 0 THEN '1' ELSE '0' END),
  struct_pack(k := 'GPSDateStamp', v := strftime(stamp, '%Y-%m-%dT%H:%M:%SZ')),
  struct_pack(k := 'GPSLatitude', v := {_dms_tag('lat')}),
  struct_pack(k := 'GPSLatitudeRef', v := CASE WHEN lat < 0 THEN 'S' ELSE 'N' END),
  struct_pack(k := 'GPSLongitude', v := {_dms_tag('lon')}),
  struct_pack(k := 'GPSLongitudeRef', v := CASE WHEN lon < 0 THEN 'W' ELSE 'E' END),
  struct_pack(k := 'GPSMapDatum', v := 'WGS-84'),
  struct_pack(k := 'GPSProcessingMethod', v := '65 83 67 73 73 0 0 0 72 89 66 82 73 68 45 70 73 88'),
  struct_pack(k := 'GPSTimeStamp', v := CAST(hour(gps_time) AS VARCHAR) || '/1 ' || CAST(minute(gps_time) AS VARCHAR) || '/1 ' || CAST(second(gps_time) AS VARCHAR) || '/1'),
  struct_pack(k := 'GPSVersionID', v := '2 2 0 0')]) AS e FROM tagged WHERE lat IS NOT NULL)
SELECT shot_id, 'Exif_GPSInfo_' || e.k AS tag, e.v AS value FROM w"""))
def _(spark, sf):
    return G.gps_tags(geotag_query(spark, sf))
