import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolake.operators import catalog as C, tags as T
from fotolake.operators.raster import geometry as G, pointwise as P
from fotolake.plans import actions as A, runner as R
from fotolake.plans.params import InvalidField, Param


def plan(*actions, version="0.2.0"):
    return {"version": version, "description": "", "actions": [{"label": n, "fields": f} for n, f in actions]}


SAVE = ("Save", {"As": "png", "In": "/out/<subfolder>"})


@pytest.fixture
def batch(spark, image):
    rng = np.random.default_rng(5)
    px = image(*[rng.integers(0, 256, (6, 8, 4)) for _ in range(3)])
    files = spark.createDataFrame(
        [(i, f"/in/a/p{i}.jpg", "/in", 10, {"Exif_Image_Artist": "x"} if i else {}) for i in range(3)],
        "image_id long, path string, root string, length long, tags map<string,string>",
    ).withColumn("mtime", F.lit("2024-03-04 05:06:07").cast("timestamp_ntz"))
    files = C.stat_vars(C.path_vars(files, base="root"))
    return R.Batch(files, px, stamps={"m": image(rng.integers(0, 256, (3, 3, 4))).drop("image_id")})


@pytest.mark.parametrize("data,word", [
    (plan(SAVE, version="0.1"), "version"),
    (plan(("Nothing", {}), SAVE), "unknown action"),
    (plan(("Invert", {"Level": "3"}), SAVE), "unknown field"),
    (plan(), "nothing to do"),
    (plan(("Invert", {"__enabled__": "no"})), "nothing to do"),
    (plan(("Invert", {})), "does not save"),
    (plan(("Invert", {"Amount": "300"}), SAVE), "not between"),
    (plan(("Scale", {"Canvas Width": "<reflect(1)>"}), SAVE), "invalid"),
    (plan(("Scale", {"Canvas Width": "wide"}), SAVE), "not a length"),
    (plan(("Write Tag", {"Tag (Exif, Iptc)": "Title"}), SAVE), "not an Exif"),
])
def test_bad_plans(data, word):
    with pytest.raises(R.InvalidPlan) as e:
        R.check_plan(R.load_plan(data), R.Settings())
    assert word in str(e.value)


def test_files_in_both_forms(tmp_path):
    data = plan(("Invert", {}), SAVE)
    (tmp_path / "a.json").write_text(json.dumps(data))
    (tmp_path / "b.txt").write_text(repr(data))
    one, two = R.load_plan(str(tmp_path / "a.json")), R.load_plan(str(tmp_path / "b.txt"))
    assert one == two and R.plan_vars(one) == {"subfolder", "filename", "dpi", "compression"}


def test_steps_equal_direct_calls(batch):
    steps = R.load_plan(plan(("Scale", {"Canvas Width": "50%", "Canvas Height": "<height//2>", "Constrain Proportions": "no"}),
                             ("Invert", {}), ("Border", {"Border Width": "25%"}), SAVE))
    got = R.run_plan(steps, batch).pixels
    from fotolake.operators.raster import composite as K

    want = K.border(P.invert(G.scale_area(batch.pixels, 4, 3)), 1)  # 25% of (4 + 3) // 2 rounds to 1
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("policy,left,severity", [("skip", 2, "error"), ("ignore", 3, "warning")])
def test_policies(batch, policy, left, severity):
    steps = R.load_plan(plan(("Offset", {"Horizontal Offset": "<int(Exif_Image_Artist.upper() == 'X')>"}), SAVE))
    out = R.run_plan(steps, batch, R.Settings(on_error=policy))
    assert out.pixels.select("image_id").distinct().count() == left
    log = out.issue_log().filter("action = 'Offset'").collect()
    assert [(r.path, r.severity) for r in log] == [("0", severity)]
    with pytest.raises(R.ActionFailed):
        R.run_plan(steps, batch, R.Settings(on_error="stop"))


def test_tags_names_and_existing(spark, batch):
    steps = R.load_plan(plan(
        ("Write Tag", {"Tag (Exif, Iptc)": "Exif_Image_Copyright", "Value": "<year> <filename>"}),
        ("Time Shift", {"Change": "Exif time", "Days": "1"}),
        ("Rename Tag", {"From (Exif, Iptc)": "Exif_Image_Copyright", "To (Exif, Iptc)": "Exif_Image_Notice"}),
        ("Delete Tags", {"Method": "One", "Tag": "Exif_Image_Artist"}),
        ("Save", {"As": "gif", "In": "<desktop>/<Exif_Image_DateTime.day>", "File Name": "<Exif_Image_Notice>"})))
    done = spark.createDataFrame([("/desktop/5/2024 p1.gif",)], "target string")
    batch.existing = done
    out = R.run_plan(steps, batch, R.Settings(overwrite_existing_images=False))
    assert sorted(r.target for r in out.report().collect()) == ["/desktop/5/2024 p0.gif", "/desktop/5/2024 p2.gif"]
    assert not R.overwrites_source(steps[-1])
    assert R.overwrites_source(R.load_plan(plan(("Save", {})))[0])
    assert {r.save_mode for r in out.exports[0].collect()} == {"P"}


def test_geotag_step(spark, batch):
    pts = spark.createDataFrame([("all", "2024-03-04 06:00:00", 1.5, 2.5, 3.0)],
                                "camera string, t string, lat double, lon double, ele double"
                                ).withColumn("t", F.col("t").cast("timestamp"))
    batch.tracks["t.gpx"] = pts
    batch.files = T.set_tags(batch.files, {"Exif_Image_DateTime": F.lit("2024:03:04 05:06:07")})
    steps = R.load_plan(plan(("Geotag", {"GPS Data (gpx)": "t.gpx"}), ("Save Tags", {})))
    out = R.run_plan(steps, batch)
    tags = out.files.first()["tags"]
    assert tags["Exif_GPSInfo_GPSLatitude"] == "1/1 30/1 0/1" and out.gps_reports[0].count() == 3


def test_stamps_text_and_missing_stamp(batch):
    steps = R.load_plan(plan(
        ("Watermark", {"Mark": "m", "Method": "By Offset", "Position": "Bottom Right", "Orientation": "Rotate 90"}),
        ("Mask", {"Mask": "m"}), ("Highlight", {"Highlight": "m", "Opacity": "40"}),
        ("Background", {"Fill": "Image", "Mark": "m", "Method": "Tile"}),
        ("Text", {"Text": "<filename>", "Position": "Top Left"}), SAVE))
    out = R.run_plan(steps, batch)
    assert out.pixels.count() == 3 * 48 and out.captions[0].filter("text = 'p1' AND align_x = 'Left'").count() == 1
    with pytest.raises(R.InvalidPlan):
        R.run_plan(R.load_plan(plan(("Mask", {"Mask": "gone"}), SAVE)), batch)


def test_registered_numpy_action_over_blocks(image, array_of):
    def soften(a):
        p = np.pad(a.astype(int), ((1, 1), (0, 0), (0, 0)), mode="edge")
        return (p[:-2] + p[1:-1] + p[2:]) // 3

    A.register_raster("Soften", soften, halo=1)
    a = np.random.default_rng(6).integers(0, 256, (150, 3, 4))
    try:
        assert (array_of(A.ACTIONS["Soften"].fn(image(a))) == soften(a)).all()
    finally:
        del A.ACTIONS["Soften"]


def test_every_action_runs_with_its_defaults(spark, batch):
    for label, action in A.ACTIONS.items():
        if action.on != "pixels":
            continue
        fields = {action.stamp: "m"} if action.stamp and label != "Tamogen" else {}
        if label == "Tamogen":
            fields, batch.stamps["f"] = {"Fill Image": "f", "Rows": "2", "Columns": "2"}, batch.pixels
        if label == "Convert Mode":
            fields = {"Mode": "Grayscale (8-bit pixels)"}
        out = R.run_plan(R.load_plan(plan((label, fields), SAVE)), batch, R.Settings(materialize=False))
        assert out.pixels.columns[0] == "image_id", label
        out.pixels._jdf.queryExecution().executedPlan()


def test_parameter_grid_and_number_kinds(spark):
    grid = R.parameter_grid(A.ACTIONS["Reflection"])
    assert len(grid) == 2 * 2 * 4
    assert len(R.parameter_grid(A.ACTIONS["Invert"], extended=True)) == 3
    assert Param("Amount", "slider", "1", 0, 100).value("<2*30>", set()) == 60
    with pytest.raises(InvalidField):
        Param("Radius", "int", "3", 3, 5).value("<width>", {"width"})


def test_repeats_keep_all_images(batch):
    files = C.repeated(batch.files.withColumn("imageindex", F.col("image_id")), 2)
    steps = R.load_plan(plan(("Invert", {}), ("Save", {"As": "png", "In": "/out", "File Name": "<filename>_<repeatindex>"})))
    out = R.run_plan(steps, R.Batch(files, batch.pixels), R.Settings(repeat=2))
    assert out.pixels.groupBy("image_id").count().orderBy("image_id").collect() == [(f"{i}#{r}", 48) for i in range(3) for r in range(2)]
    names = {(r.image_id, r.target) for r in out.exports[0].collect()}
    assert names == {(f"{i}#{r}", f"/out/p{i}_{r}.png") for i in range(3) for r in range(2)}


def test_repeats_without_an_index(batch):
    out = R.run_plan(R.load_plan(plan(("Invert", {}))), batch, R.Settings(repeat=3, no_save=True))
    assert out.pixels.count() == 3 * 3 * 48 and out.files.count() == 9


@pytest.mark.parametrize("dpi, good", [("144", True), ("<dpi>", True), ("0", False), ("-3", False), ("144 px", False), ("many", False)])
def test_resolution_is_a_positive_number(batch, dpi, good):
    steps = R.load_plan(plan(("Scale", {"Canvas Width": "0.5 inch", "Canvas Height": "0.5 inch", "Resolution": dpi, "Constrain Proportions": "no"})))
    if not good:
        with pytest.raises(R.InvalidPlan, match="dpi"):
            R.run_plan(steps, batch, R.Settings(no_save=True))
        return
    size = R.run_plan(steps, batch, R.Settings(no_save=True)).pixels.select("width", "height").distinct().collect()
    assert size == [(72, 72)] if dpi == "144" else size == [(36, 36)]
