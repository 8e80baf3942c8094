import pytest
from pyspark.sql import functions as F

from fotolake.functions import paths as P, units as U, values as V
from fotolake.functions.templates import UnsafeTemplate, check_template, required_vars, template
from fotolake.plans.params import InvalidField, Param


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return df.select(col).first()[0]


@pytest.mark.parametrize("text,values,want", [
    ("<1+1>_<abs(2-3)>", {}, "2_1"),
    ("<###(index+1)>", {"index": 1}, "002"),
    ("<##month>-<##day>", {"month": 3, "day": 14}, "03-14"),
    ("<max(width,height)> px", {"width": 30, "height": 40}, "40 px"),
    ("<filename.upper()>.<lower(type)>", {"filename": "beach", "type": "JPG"}, "BEACH.jpg"),
    ("<size[0]>x<size[1]>", {"width": 3, "height": 5}, "3x5"),
    ("<width//2>", {"width": 7}, "3"),
    ("<width/2>", {"width": 7}, "3"),
    ("<width/2.0>", {"width": 7}, "3.5"),
    ("<filename[:3]>_<filename[3:]>", {"filename": "beach"}, "bea_ch"),
    ("<####index>", {"index": 12345}, "12345"),
    ("plain", {}, "plain"),
    ("", {}, ""),
])
def test_values(spark, text, values, want):
    assert one(spark, template(text, set(values)), **values) == want


def test_tags_and_missing_tags(spark):
    df = spark.sql("SELECT map('Exif_Photo_DateTimeOriginal', '2008:03:14 10:11:12', 'Exif_A_B', '3/4') AS tags")
    get = lambda t: df.select(template(t, {"tags"})).first()[0]
    assert get("<Exif_Photo_DateTimeOriginal.year>_<Exif_Photo_DateTimeOriginal.monthname>") == "2008_March"
    assert get("<Exif_Photo_DateTimeOriginal.weekday>") == "4"
    assert get("<Exif_A_B.denominator>") == "4"
    assert get("x_<Exif_Image_Missing>") is None


@pytest.mark.parametrize("text", ["<reflect('java.lang.System', 'exit')>", "<java_method(a)>", "<__import__('os')>",
                                  "<secret>", "<index.real>", "<(select 1)>", "<a;b>", "<index**2>", "<lambda>"])
def test_unsafe(text):
    assert check_template(text, {"index"})
    with pytest.raises(UnsafeTemplate):
        template(text, {"index"})


def test_required_vars():
    assert required_vars("<##month>_<max(width, 3)>_<Exif_Image_DateTime.year>_<size[0]>_<pi>") == {
        "month", "width", "height", "Exif_Image_DateTime"}


@pytest.mark.parametrize("text,want", [("5%", 10), ("-5%", -10), ("2 cm", 57), ("1 inch", 72), ("10px", 10), ("10", 10),
                                       ("25.4mm", 72), ("0.4 %", 1), ("ten", None), ("", None),
                                       ("50% - 10px", 90), ("2*1cm", 57), ("7/2 px", 3), ("7.0/2", 4), ("10 - -5", 15),
                                       ("-3/2", -1), ("1cm*2", 57), ("1/0", None), ("5 5", None), ("50%-", None)])
def test_length(spark, text, want):
    assert one(spark, U.length_px(text, 200)) == want
    assert one(spark, U.length_px(F.lit(text), 200)) == want


@pytest.mark.parametrize("text,want", [("5kb", 5120), ("5mb", 5242880), ("10 bt", 10), ("1gb", 1 << 30), ("x", None)])
def test_size(spark, text, want):
    assert one(spark, U.size_bytes(text)) == want


def test_placement(spark):
    assert one(spark, U.place(50, "Left", 100, 10)) == 50
    assert one(spark, U.place(50, "Middle", 100, 10)) == 45
    assert one(spark, U.place(-5, "Right", 100, 10)) == 85
    w, h = U.fit_inside(400, 300, 80, 80)
    assert (one(spark, w), one(spark, h)) == (80, 60)
    assert U.negate_length("-5%") == "5%" and U.negate_length("5%") == "-5%"


@pytest.mark.parametrize("path,name,kind", [("/a/b.tar.gz", "b.tar", "gz"), ("/a/.hidden", ".hidden", ""),
                                            ("/a/x", "x", ""), ("/home/world.JPG", "world", "JPG")])
def test_paths(spark, path, name, kind):
    assert one(spark, P.filename(F.lit(path))) == name
    assert one(spark, P.file_type(F.lit(path))) == kind


def test_format_and_uri(spark):
    assert [one(spark, P.image_format(F.lit(e))) for e in ("jpg", ".jpe", "tif", "png", "svgz")] == [
        "JPEG", "JPEG", "TIFF", "PNG", "SVG"]
    assert one(spark, P.strip_file_scheme(F.lit("file:///a/b"))) == "/a/b"
    assert one(spark, P.is_url(F.lit("http://x/y.png"))) and not one(spark, P.is_url(F.lit("/x/y.png")))
    assert one(spark, P.title_of(F.lit("/a/my_summer-photo.jpg"))) == "My Summer Photo"


@pytest.mark.parametrize("start,delta,want", [
    ("2024-01-31 00:00:00", {"months": 1}, "2024-02-29 00:00:00"),
    ("2024-02-29 00:00:00", {"years": 1}, "2025-02-28 00:00:00"),
    ("2024-01-31 00:00:00", {"months": 1, "days": 1}, "2024-03-01 00:00:00"),
    ("2024-01-01 00:00:10", {"seconds": -11}, "2023-12-31 23:59:59"),
])
def test_time_shift(spark, start, delta, want):
    assert str(one(spark, V.shift_time(F.lit(start).cast("timestamp_ntz"), **delta))) == want


def test_dms(spark):
    assert one(spark, V.dms_text(F.lit(-33.51), "N", "S")) == "33.30'36\"S"
    assert one(spark, V.dms_text(F.lit(0.0), "E", "W")) == "00.00'00\"E"


def test_params():
    p = Param("Amount", "slider", "50", 0, 100)
    assert p.constant("70") == 70
    for bad in ("700", "x"):
        with pytest.raises(InvalidField):
            p.constant(bad)
    assert Param("B", "bool", "no").constant("Yes") is True
    assert Param("C", "choice", "a", choices=("a",)).check("b", set())
    assert Param("L", "length", "5%").check("5 parsecs", set())
    assert not Param("L", "length", "5%").check("<min(width,height)> px", {"width", "height"})
    assert Param("T", "tag", "Exif_Image_Make").check("Make", set())


def test_smallest_of_a_missing_value_is_missing(spark):
    from pyspark.sql import functions as F

    from fotolake.functions.templates import template

    df = spark.createDataFrame([(5, None), (5, 2)], "w int, h int")
    got = df.select(template("<max(h,3)>-<min(w,h)>", {"w", "h"}).alias("a"), template("<###h>", {"w", "h"}).alias("b"), F.lit(1)).collect()
    assert [(r.a, r.b) for r in got] == [(None, None), ("3-2", "002")]


def test_directories_that_loop_or_claim_too_much():
    import struct

    from fotolake.sources.metadata import parse_header

    entries = [(0x8769, 4, 1, 8), (0x010F, 2, 1 << 31, 8), (0x0112, 3, 1, 6)]
    buf = b"II*\0" + struct.pack("<IH", 8, len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + bytes(4)
    assert [(t, v) for t, v, _ in parse_header(buf)] == [("Exif_Image_Orientation", "6")]
