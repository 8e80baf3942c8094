import os
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolake.operators import catalog as C, diff as D, export as E
from fotolake.session import scratch
from fotolake.sources import files as FS, gpx, images as I, metadata as MD
from fotolake.sources.samples import png_bytes
from fotolake.streaming import ingest as S

RGB = np.array([[[1, 2, 3], [4, 5, 6], [7, 8, 9]], [[10, 11, 12], [13, 14, 15], [16, 17, 18]]])
RGBA = np.array([[[1, 2, 3, 4], [5, 6, 7, 0]]])


def exif_block(order="<"):
    """A directory with a make, an orientation, a rational and a GPS sub-directory."""
    e = struct.Struct(order + "HHII")
    make, res, lat = b"Acme Corp\0", struct.pack(order + "II", 72, 1), struct.pack(order + "6I", 51, 1, 30, 1, 0, 1)
    base = 8 + 2 + 4 * 12 + 4
    gps_at = base + len(make) + len(res)
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", 4)
    short = struct.pack(order + "HHI", 0x0112, 3, 1) + struct.pack(order + "HH", 6, 0)
    body = head + e.pack(0x010F, 2, len(make), base) + short + e.pack(0x011A, 5, 1, base + len(make)) \
        + e.pack(0x8825, 4, 1, gps_at) + struct.pack(order + "I", 0) + make + res
    gps = struct.pack(order + "H", 1) + e.pack(2, 5, 3, gps_at + 2 + 12 + 4) + struct.pack(order + "I", 0) + lat
    return body + gps


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(png_bytes(RGB, {"Author": "Ann"}, [(b"eXIf", exif_block())]))
    (tmp_path / "sub" / "B.PNG").write_bytes(png_bytes(RGBA))
    (tmp_path / "bad.png").write_text("no image")
    (tmp_path / "note.txt").write_text("x")
    return tmp_path


def test_scan(spark, folder):
    got = C.path_vars(FS.scan_files(spark, str(folder)), base="root").collect()
    assert {(r.filename, r.type, r.subfolder) for r in got} == {("a", "png", ""), ("bad", "png", ""), ("B", "PNG", "sub")}
    assert FS.scan_files(spark, str(folder), recursive=False).count() == 2
    mixed = FS.scan_files(spark, [str(folder / "sub"), str(folder / "a.png")])
    assert {r.root for r in mixed.collect()} == {str(folder), str(folder / "sub")}
    plan = FS.binary_files(spark, str(folder)).select("path")._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]


def test_listing_in_tasks(spark, tmp_path):
    """Many folders: rounds of tasks, hidden names and links to folders left out, the same files as Spark's own listing."""
    for i in range(60):
        for j in range(5):
            d = tmp_path / f"y{i}" / f"m{j}" / "d"
            d.mkdir(parents=True)
            (d / f"{i}-{j}.JPG").write_bytes(b"x" * (i + j))
    (tmp_path / "y1" / ".hidden").mkdir()
    (tmp_path / "y1" / ".hidden" / "a.jpg").write_bytes(b"x")
    (tmp_path / "y1" / "_b.jpg").write_bytes(b"x")
    (tmp_path / "y2" / "loop").symlink_to(tmp_path)
    got = FS.scan_files(spark, str(tmp_path) + "/", ["jpg"])
    files = {(r.path, r.length, r.mtime.timestamp()) for r in got.collect()}
    assert {(p, n) for p, n, _ in files} == {(f"{tmp_path}/y{i}/m{j}/d/{i}-{j}.JPG", i + j) for i in range(60) for j in range(5)}
    assert all(abs(os.stat(p).st_mtime - t) < 0.01 for p, _, t in files) and {r.root for r in got.select("root").distinct().collect()} == {str(tmp_path)}
    (tmp_path / "y2" / "loop").unlink()
    old = FS.binary_files(spark, str(tmp_path), ["jpg"]).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    assert {r.path for r in old.collect()} == {p for p, n, _ in files if n}  # which leaves out empty files
    (tmp_path / "none").mkdir()
    assert FS.scan_files(spark, str(tmp_path / "none")).isEmpty()


def test_headers_are_read_by_pages(spark, tmp_path):
    """Padded files: megabytes of pixels, a TIFF directory at the end, and only pages of headers are read."""
    png = png_bytes(RGB, {"Author": "Ann"}, [(b"eXIf", exif_block())])
    at = png.index(b"IDAT") - 4
    pad = struct.pack(">I4s", 3_000_000, b"IDAT") + bytes(3_000_000) + b"\0\0\0\0"
    (tmp_path / "p.png").write_bytes(png[:at] + pad + png[at:])
    block = exif_block()
    order = "<" if block[:2] == b"II" else ">"
    (tmp_path / "t.tif").write_bytes(block[:4] + struct.pack(order + "I", 2_000_000) + bytes(2_000_000 - 8) + struct.pack(order + "HHHII", 1, 0x0112, 3, 1, 6 if order == "<" else 6 << 16) + bytes(4))
    plain = {t[0]: t[1] for t in MD.parse_header(png)}
    found, count = MD.header_tags(str(tmp_path / "p.png"))
    assert {t[0]: t[1] for t in found} == plain and count <= 4 * 4096
    found, count = MD.header_tags(str(tmp_path / "t.tif"))
    assert ("Exif_Image_Orientation", "6", "int") in found and count <= 4 * 4096
    files = FS.scan_files(spark, str(tmp_path))
    assert {(r.tag, r.value) for r in MD.read_tags(files, ["Png_Author", "Exif_Image_Orientation"]).collect()} >= {("Png_Author", "Ann"), ("Exif_Image_Orientation", "6")}
    assert {r.tag for r in MD.read_tags(files, ["width"]).collect()} == {"width"}
    gone = files.union(files.limit(1).withColumn("path", F.lit(str(tmp_path / "gone.png"))))
    assert MD.read_tags(gone, ["width"]).count() == 1


def test_copies_survive_a_killed_task(spark, tmp_path):
    """A worker that dies half way leaves no target; the next run makes it whole."""
    from fotolake.sources import sinks as K

    src, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "died"
    src.mkdir()
    data = os.urandom(3_000_000)
    for i in range(4):
        (src / f"{i}.bin").write_bytes(data + bytes([i]))
    rows = [(f"{src}/{i}.bin", f"{out}/{i}.bin") for i in range(4)] + [(f"{src}/none.bin", f"{out}/none.bin"), (f"{src}/3.bin", f"{out}/0.bin"), (f"{src}/1.bin", None)]
    plan = spark.createDataFrame(rows, "path string, target string")

    def dying(source, target):
        if source.endswith("2.bin") and not mark.exists():
            mark.write_text("x")
            out.mkdir(exist_ok=True)
            with open(target, "wb") as o:
                o.write(data[:1_000_000])
            os._exit(1)
        K._copy(source, target)

    with pytest.raises(Exception, match="Python worker"):
        K.apply_copies(plan, move=True, copy=dying)
    assert not [f for f in os.listdir(out) if not f.startswith(".")] and len(os.listdir(src)) == 4
    outcome = {(r.path.rpartition("/")[2], r.target.rpartition("/")[2]): r.outcome for r in K.apply_copies(plan, move=True, copy=dying).collect()}
    assert outcome == {("0.bin", "0.bin"): "copied", ("1.bin", "1.bin"): "copied", ("2.bin", "2.bin"): "copied", ("3.bin", "3.bin"): "copied", ("none.bin", "none.bin"): "missing", ("3.bin", "0.bin"): "loses"}
    assert all((out / f"{i}.bin").read_bytes() == data + bytes([i]) for i in range(4)) and os.listdir(src) == []
    (src / "1.bin").write_bytes(b"new")
    assert {r.outcome for r in K.apply_copies(plan.filter("path LIKE '%1.bin'")).collect()} == {"exists"}
    K.apply_copies(plan.filter("path LIKE '%1.bin'"), overwrite=True)
    assert (out / "1.bin").read_bytes() == b"new" and not [f for f in os.listdir(out) if f.startswith(".") and "whole" in f]


def test_decode_and_verify(spark, folder):
    images = I.read_images(spark, [str(folder / "*.png"), str(folder / "sub" / "B.PNG")])
    valid, invalid = I.verify(images)
    assert {r.path.rsplit("/", 1)[1] for r in invalid.collect()} == {"bad.png"}
    assert {(r.width, r.height, r.bands) for r in valid.collect()} == {(3, 2, 3), (2, 1, 4)}
    px = {(r.path.rsplit("/", 1)[1], r.y, r.x): (r.r, r.g, r.b, r.a) for r in I.read_pixels(images).collect()}
    assert px[("a.png", 1, 0)] == (10, 11, 12, None) and px[("B.PNG", 0, 1)] == (5, 6, 7, 0) and len(px) == 8
    names = valid.select(I.mode_name(F.col("bands")).alias("m")).collect()
    assert {r.m for r in names} == {"RGB", "RGBA"}


def test_strips(spark, folder):
    images = I.read_images(spark, [str(folder / "*.png"), str(folder / "sub" / "B.PNG")])
    got = {r.path.rsplit("/", 1)[1]: (r.y0, r.rows, r.bands, bytes(r.data)) for r in I.read_strips(images).collect()}
    assert got == {"a.png": (0, 2, 3, RGB.astype(np.uint8).tobytes()), "B.PNG": (0, 1, 4, RGBA.astype(np.uint8).tobytes())}


def test_tags(spark, folder):
    rows = MD.read_tags(FS.binary_files(spark, str(folder), ["png"])).collect()
    a = {r.tag: r.value for r in rows if r.path.endswith("a.png")}
    assert a["mode"] == "RGB" and a["Png_Author"] == "Ann" and a["size"] == "3 2"
    assert a["Exif_Image_Make"] == "Acme Corp" and a["Exif_Image_Orientation"] == "6"
    assert a["Exif_Image_XResolution"] == "72/1" and a["Exif_GPSInfo_GPSLatitude"] == "51/1 30/1 0/1"
    assert not [r for r in rows if r.path.endswith("bad.png")]


def test_jpeg_and_tiff_headers():
    exif = b"Exif\0\0" + exif_block(">")
    iptc = b"Photoshop 3.0\0" + b"\x1c\x02\x78" + struct.pack(">H", 2) + b"hi"
    seg = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    sof = seg(0xC0, b"\x08" + struct.pack(">HHB", 20, 30, 3) + b"\0" * 9)
    jpeg = b"\xff\xd8" + seg(0xE1, exif) + seg(0xED, iptc) + sof + seg(0xDA, b"")
    got = {t: v for t, v, _ in MD.parse_header(jpeg)}
    assert got["width"] == "30" and got["Exif_Image_Make"] == "Acme Corp"
    assert got["Iptc_Application2_Caption"] == "hi"
    assert {t for t, _, _ in MD.parse_header(exif_block())} >= {"Exif_Image_Make"}
    assert MD.parse_header(jpeg[:30]) == [] and MD.parse_header(b"") == []


def test_gpx(spark, tmp_path):
    point = '<trkpt lat="-1.5" lon="{}"><ele>7</ele><time>2024-01-0{}T00:00:00Z</time></trkpt>'
    (tmp_path / "a.gpx").write_text("<gpx><trk><trkseg>" + point.format("2.5", 1) + point.format("3.5", 1) + "</trkseg></trk></gpx>")
    (tmp_path / "b.gpx").write_text('<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>' + point.format("4.5", 2)
                                    + "</trkseg></trk></gpx>")
    rows = gpx.read_gpx(spark, str(tmp_path)).collect()
    assert {(r.t.day, r.lat, r.lon, r.ele) for r in rows} == {(1, -1.5, 3.5, 7.0), (2, -1.5, 4.5, 7.0)}
    assert gpx.one_track(gpx.read_gpx(spark, str(tmp_path))).count() == 2


def test_stream_reads_old_files_once_and_rescan_finds_changes(spark, folder):
    base = scratch(spark, "t")
    old = folder / "a.png"
    os.utime(old, (10**9, 10**9))  # far older than the default age limit
    run = lambda: S.ingest(S.new_files(spark, str(folder), "*.png"), base + "/c", base + "/p").awaitTermination()
    run()
    run()
    (folder / "new.png").write_bytes(png_bytes(RGBA))
    (folder / "epoch.png").write_bytes(png_bytes(RGBA))
    os.utime(folder / "epoch.png", (0, 0))  # arrives late, with the oldest time there is
    run()
    catalog = spark.read.parquet(base + "/c")
    assert sorted(r.path.rsplit("/", 1)[1] for r in catalog.collect()) == ["a.png", "bad.png", "epoch.png", "new.png"]
    time.sleep(0.01)
    old.write_bytes(png_bytes(RGB))
    listing = FS.scan_files(spark, str(folder), ["png"])
    got = {(r.path.rsplit("/", 1)[1], r.change) for r in S.rescan(catalog, listing).collect()}
    assert got == {("a.png", "modified"), ("B.PNG", "new")}


def test_diff_reports_metadata(spark, image):
    px = image(np.zeros((2, 2, 4), int), np.ones((2, 2, 4), int))
    status = D.corpus_diff(px, px)
    changes = spark.createDataFrame([(1, "t", "a", "b")], "image_id long, tag string, old_value string, new_value string")
    assert {(r.image_id, r.status) for r in D.with_tag_status(status, changes).collect()} == {
        (0, "same"), (1, "mismatch: metadata")}


def test_collisions_in_place_and_issue_numbers(spark):
    df = C.path_vars(spark.createDataFrame([("/a/x.png",), ("/b/x.png",), ("/out/x.png",)], "path string"))
    plan = E.export_plan(df, folder="/out")
    assert E.name_collisions(plan).collect()[0]["sources"] == 3
    assert [r.path for r in E.in_place(plan).collect()] == ["/out/x.png"]
    issues = plan.select("path", F.lit("save").alias("action"), F.lit("error").alias("severity"), F.lit("m").alias("message"))
    assert sorted(r.number for r in E.number_issues(issues).collect()) == [1, 2, 3]


def test_sinks(spark, folder, image, tmp_path):
    from fotolake.sources import sinks as K

    px = image(np.zeros((2, 2, 4), int), np.ones((3, 1, 3), int))
    K.write_rasters(px, str(tmp_path / "packed"))
    K.write_rasters(px, str(tmp_path / "plain"), packed=False)
    back = spark.read.parquet(str(tmp_path / "packed"))
    assert {(r.image_id, r.bands, len(r.data)) for r in back.collect()} == {(0, 4, 16), (1, 3, 9)}
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 7
    report = spark.createDataFrame([("t", "u")], "`camera time` string, `nearest gps` string")
    K.write_gps_report(report, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["camera time", "nearest gps"]
    out = str(tmp_path / "out")
    plan = E.copy_plan(C.path_vars(FS.scan_files(spark, str(folder), ["png"])), "<filename>_c", out)
    K.apply_copies(plan)
    K.apply_copies(plan)
    assert sorted(os.listdir(out)) == ["B_c.PNG", "a_c.png", "bad_c.png"]
    K.apply_copies(plan, move=True, overwrite=True)
    assert not (folder / "a.png").exists() and (tmp_path / "out" / "a_c.png").read_bytes() == png_bytes(
        RGB, {"Author": "Ann"}, [(b"eXIf", exif_block())])
