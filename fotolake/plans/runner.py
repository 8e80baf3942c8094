"""Action lists: reading, checking and running them as one lazy plan per table."""

from __future__ import annotations

import ast
import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..functions.paths import IMAGE_EXTENSIONS
from ..functions.templates import check_template, required_vars, template
from ..functions.units import length_px, place, position_preset
from ..operators import catalog as C, export as E, geo, tags as T
from ..operators.raster import composite as K, core
from ..session import written
from .actions import ACTIONS, Action
from .params import InvalidField

VERSION = "0.2"
SIZE_VARS = {"width", "height", "dpi", "size"}
STATIC_VARS = {
    "path", "folder", "root", "foldername", "subfolder", "filename", "type", "filesize", "year", "month", "day",
    "hour", "minute", "second", "weekday", "weekdayname", "monthname", "index", "imageindex", "repeatindex",
    "folderindex", "width", "height", "dpi", "mode", "format", "compression", "transparency", "desktop", "tags",
}


class InvalidPlan(ValueError):
    """An action list that cannot be run; ``args[0]`` lists the reasons."""


class ActionFailed(RuntimeError):
    """Raised under the ``stop`` policy for the first image an action cannot handle."""


@dataclass
class Settings:
    """Batch settings."""

    extensions: list[str] = field(default_factory=lambda: list(IMAGE_EXTENSIONS))
    recursive: bool = False
    on_error: str = "stop"                  # stop, skip or ignore
    overwrite_existing_images: bool = True
    no_save: bool = False
    check_images_first: bool = True
    repeat: int = 1
    dpi: int = 72
    desktop: str = "/desktop"               # what <desktop> stands for
    materialize: bool = True                # checkpoint where a table is read more than once


@dataclass
class Step:
    """One enabled action with its field texts."""

    action: Action
    texts: dict[str, str]
    stamp: str | None = None


def read_action_list(path: str) -> dict:
    """Action list file, JSON or the plain dictionary form; nothing in it is executed."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    try:
        return json.loads(source)
    except json.JSONDecodeError:
        return ast.literal_eval(source)


def load_plan(data: dict | str) -> list[Step]:
    """Enabled steps of an action list.  Unknown versions, actions or fields are errors."""
    if isinstance(data, str):
        data = read_action_list(data)
    if not str(data.get("version", "")).startswith(VERSION):
        raise InvalidPlan([f"version {data.get('version')!r} is not {VERSION}"])
    steps, bad = [], []
    for item in data["actions"]:
        label, fields = item["label"], dict(item.get("fields", {}))
        if label not in ACTIONS:
            bad.append(f"unknown action {label}")
            continue
        action = ACTIONS[label]
        enabled = str(fields.pop("__enabled__", "yes")).lower() in ("yes", "true", "1")
        stamp = fields.pop(action.stamp, None) if action.stamp else None
        by_label = {p.label: name for name, p in action.params.items()}
        bad += [f"unknown field {f} ({label})" for f in fields if f not in by_label]
        texts = {name: fields.get(p.label, p.default) for name, p in action.params.items()}
        if enabled:
            steps.append(Step(action, texts, stamp))
    if bad:
        raise InvalidPlan(bad)
    return steps


def plan_vars(steps: list[Step]) -> set[str]:
    """Variables the fields of an action list read."""
    return reduce(set.union, (required_vars(str(t)) for s in steps for t in s.texts.values()), set())


def check_plan(steps: list[Step], settings: Settings, variables=STATIC_VARS) -> None:
    """Not empty, safe, values in range, and ending in an action that writes."""
    if not steps:
        raise InvalidPlan(["nothing to do: no action is enabled"])
    bad = [b for s in steps for name, p in s.action.params.items() for b in p.check(s.texts[name], variables)]
    if not (steps[-1].action.valid_last or settings.no_save):
        bad.append("the last action does not save")
    if bad:
        raise InvalidPlan(bad)


def overwrites_source(step: Step) -> bool:
    """Whether an output step writes in place, so that overwriting is forced."""
    t = step.texts
    in_place = t.get("name") == "<filename>" and t.get("folder") in ("<folder>", "<folder>/<subfolder>")
    return step.action.label == "Save Tags" or (in_place and t.get("type", "<type>") == "<type>")


@dataclass
class Batch:
    """Tables a plan runs on: files (image_id, path, tags, variables) and pixels by image_id."""

    files: DataFrame
    pixels: DataFrame | None = None
    stamps: dict[str, DataFrame] = field(default_factory=dict)
    tracks: dict[str, DataFrame] = field(default_factory=dict)
    existing: DataFrame | None = None


@dataclass
class Result:
    files: DataFrame
    pixels: DataFrame | None
    exports: list[DataFrame]
    outputs: list[DataFrame]
    captions: list[DataFrame]
    gps_reports: list[DataFrame]
    issues: list[DataFrame]

    def report(self) -> DataFrame:
        if not self.exports:
            none = "CAST(NULL AS STRING)"
            return E.report(self.files.selectExpr("*" if "path" in self.files.columns else f"*, {none} AS path", f"{none} AS target").limit(0))
        return reduce(DataFrame.unionByName, [E.report(e) for e in self.exports])

    def issue_log(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, self.issues) if self.issues else None


def _corner(pixels: DataFrame) -> DataFrame:
    return pixels.filter((F.col("x") == 0) & (F.col("y") == 0))


def _with_variables(pixels: DataFrame, files: DataFrame, names: set[str], settings: Settings) -> DataFrame:
    """Pixels with dpi and, only where a field reads them, the file variables it needs."""
    out = pixels.withColumn("dpi", F.lit(settings.dpi))
    cols = [c for c in files.columns if c in names - SIZE_VARS]
    if any(n.startswith(("Exif_", "Iptc_")) for n in names):
        cols.append("tags")
    if cols:
        facts = _corner(pixels).select("image_id", "width", "height").join(
            files.select("image_id", *cols).dropDuplicates(["image_id"]), "image_id", "left")
        out = core.join_per_image(out, facts)
    return out


def _per_repeat(df: DataFrame, repeat: int) -> DataFrame:
    """One image per repeat, named ``image_id#repeatindex``."""
    if "repeatindex" not in df.columns:
        df = df.withColumn("repeatindex", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
    return df.withColumn("image_id", F.concat(F.col("image_id").cast("string"), F.lit("#"), F.col("repeatindex")))


ORIENTATION = "Exif_Image_Orientation"


# Actions that read their input twice: an aggregate or a second image is joined back.
READ_TWICE = {"Contrast", "Auto Contrast", "Equalize", "Crop", "Color to Alpha", "Transpose", "Rotate",
              "Perspective", "Tamogen"}


def _bad_rows(values: dict, texts: dict) -> Column | None:
    """Rows without a value.  Constants and sizes were checked before the run; only fields
    that read file variables or tags can lack one."""
    cols = [v.isNull() for k, v in values.items()
            if isinstance(v, Column) and required_vars(str(texts[k])) - SIZE_VARS]
    return reduce(lambda a, b: a | b, cols) if cols else None


class Runner:
    """Folds the steps over the tables.  Steps stay lazy up to a table that is read twice,
    which is written once; the ``stop`` policy looks for one bad row."""

    def __init__(self, batch: Batch, settings: Settings):
        self.settings = settings
        self.batch = batch
        self.files = batch.files.withColumn("desktop", F.lit(settings.desktop)) \
            if "desktop" not in batch.files.columns else batch.files
        self.pixels = batch.pixels
        if settings.repeat > 1:
            self.files = _per_repeat(self.files, settings.repeat)
            if self.pixels is not None:
                self.pixels = _per_repeat(self.pixels, settings.repeat).select(*core.COLUMNS)
        self.result = Result(self.files, self.pixels, [], [], [], [], [])
        self.pending = 0  # pixel steps since the pixels were last written

    def _guard(self, label: str, table: DataFrame, values: dict, texts: dict, per_image: DataFrame):
        """Apply the error policy to images whose column values are missing."""
        bad = _bad_rows(values, texts)
        if bad is None:
            return table, None
        failed = per_image.filter(bad)
        policy = self.settings.on_error
        if policy == "stop":
            first = failed.select("image_id").head(1)
            if first:
                raise ActionFailed(f"{label}: a field has no value for image {first[0][0]}")
            return table, None
        self.result.issues.append(failed.select(
            F.col("image_id").cast("string").alias("path"), F.lit(label).alias("action"),
            F.lit("error" if policy == "skip" else "warning").alias("severity"),
            F.lit("a field has no value").alias("message")))
        kept = table.filter(~bad)
        return kept, (table.filter(bad) if policy == "ignore" else None)

    def _pixels(self, step: Step) -> None:
        if self.pixels is None:
            raise InvalidPlan([f"{step.action.label} needs pixels"])
        if step.action.label in READ_TWICE:
            self._materialize()
        names = reduce(set.union, (required_vars(str(t)) for t in step.texts.values()), set())
        upright = step.action.label == "Transpose" and step.texts["method"] == "Orientation" and "tags" in self.files.columns
        if upright:
            names.add(ORIENTATION)
        table = _with_variables(self.pixels, self.files, names, self.settings)
        variables = set(table.columns)
        for key, p in step.action.params.items():
            if p.kind == "dpi":  # the lengths of this action are in its own resolution
                table = table.withColumn("dpi", p.value(step.texts[key], variables))
        values = {k: p.value(step.texts[k], variables) for k, p in step.action.params.items()}
        table, untouched = self._guard(step.action.label, table, values, step.texts, _corner(table))
        if step.action.stamp:
            needed = not (step.action.label == "Background" and step.texts.get("fill") == "Color")
            pixels = self.batch.stamps.get(step.stamp)
            if needed and pixels is None:
                raise InvalidPlan([f"{step.action.label}: no image named {step.stamp!r}"])
            values["stamp"] = K.Stamp.of(pixels) if needed else None
        out = step.action.fn(table, **values).select(*core.COLUMNS)
        if untouched is not None:
            out = out.unionByName(untouched.select(*core.COLUMNS))
        if upright:  # what is saved from here on needs no more turning
            self.files = self.files.withColumn("tags", F.transform_values(
                "tags", lambda k, v: F.when(k == ORIENTATION, F.lit("1")).otherwise(v)))
        self.pixels = out
        self.pending += 1

    def _materialize(self) -> None:
        """Write the pixels to a table in the shared folder, so that what follows reads
        them instead of repeating the steps before."""
        if self.settings.materialize and self.pending:
            self.pixels, self.pending = written(self.pixels, "pixels"), 0

    def _files(self, step: Step) -> None:
        if step.action.label == "Geotag":
            return self._geotag(step)
        variables = set(self.files.columns)
        values = {k: p.value(step.texts[k], variables) for k, p in step.action.params.items()}
        table, untouched = self._guard(step.action.label, self.files, values, step.texts, self.files)
        out = step.action.fn(table, **values)
        self.files = out if untouched is None else out.unionByName(untouched)

    def _geotag(self, step: Step) -> None:
        track = self.batch.tracks.get(step.texts["track"].strip())
        if track is None:
            raise InvalidPlan([f"Geotag: no track named {step.texts['track']!r}"])
        camera = F.col("camera") if "camera" in self.files.columns else F.lit("all")
        shots = self.files.select(F.col("image_id").alias("shot_id"), camera.alias("camera"),
                                  V.exif_time(T.tag(T.TIME_TAGS[0])).alias("taken")).filter("taken IS NOT NULL")
        tagged = geo.geotag(shots, track, int(step.texts["shift"]))
        self.result.gps_reports.append(geo.gps_report(tagged))
        new = T.to_map(geo.gps_tags(tagged).withColumnRenamed("shot_id", "image_id")).withColumnRenamed("tags", "_gps")
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        joined = self.files.join(new, "image_id", "left").withColumn("_gps", F.coalesce("_gps", none))
        old = F.map_filter("tags", lambda k, v: ~F.map_contains_key(F.col("_gps"), k))
        self.files = joined.withColumn("tags", F.map_concat(old, F.col("_gps"))).drop("_gps")

    def _sized(self) -> DataFrame:
        """Files with the current width, height and mode of their pixels."""
        if self.pixels is None:
            return self.files
        now = _corner(self.pixels).select(
            "image_id", "width", "height", F.when(F.col("a").isNull(), "RGB").otherwise("RGBA").alias("mode"))
        keep = [c for c in self.files.columns if c not in ("width", "height", "mode")]
        return self.files.select(*keep).join(now, "image_id")

    def _caption(self, step: Step) -> None:
        self.result.captions.append(caption(self._sized(), self.settings.dpi, **step.texts))

    def _output(self, step: Step) -> None:
        if self.pixels is not None:
            self._materialize()  # read by the outputs, the export plan and the next steps
        t = step.texts
        plan = E.export_plan(self._sized(), t["name"], t["folder"], t.get("type", "<type>"))
        self.result.issues.append(E.template_issues(plan, step.action.label))
        if self.pixels is not None:
            unknown = _corner(self.pixels).join(self.files, "image_id", "left_anti")
            self.result.issues.append(unknown.select(
                F.col("image_id").cast("string").alias("path"), F.lit(step.action.label.lower()).alias("action"),
                F.lit("error").alias("severity"), F.lit("no file belongs to this image").alias("message")))
        if self.settings.on_error == "stop" and plan.filter("target IS NULL").head(1):
            raise ActionFailed(f"{step.action.label}: a name reads a missing value")
        if self.batch.existing is not None and not self.settings.overwrite_existing_images \
                and not overwrites_source(step):
            plan = E.skip_existing(plan, self.batch.existing)
        if step.action.label == "Save" and "mode" in plan.columns:
            plan = E.save_mode(plan)
            self.result.issues.append(E.mode_issues(plan))
        self.result.exports.append(plan)
        if self.pixels is not None and step.action.label == "Save":
            self.result.outputs.append(self.pixels)

    def run(self, steps: list[Step]) -> Result:
        kinds = {"pixels": self._pixels, "files": self._files, "caption": self._caption, "output": self._output}
        for step in steps:
            if step.action.on == "output" and self.settings.no_save:
                continue
            kinds[step.action.on](step)
        self.result.files, self.result.pixels = self.files, self.pixels
        return self.result


def run_plan(steps: list[Step], batch: Batch, settings: Settings | None = None) -> Result:
    """Check, then fold the steps.  The result's tables are lazy; write them to run the job."""
    settings = settings or Settings()
    check_plan(steps, settings)
    return Runner(batch, settings).run(steps)


def catalog_of(files: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Scan rows to the file table of a batch: variables, indexes, repeats."""
    s = settings or Settings()
    df = C.filter_ext(files, s.extensions)
    base = "root" if "root" in df.columns else None
    return C.indexed(C.stat_vars(C.path_vars(df, base=base)), repeat=s.repeat)


def caption(files: DataFrame, dpi: int = 72, text: str = "", size: str = "5%", color: str = "#000000",
            position: str = "Center", offset: str = "5%", h: str = "50%", v: str = "50%", hj: str = "Middle",
            vj: str = "Middle", orientation: str = "Normal", font: str = "") -> DataFrame:
    """Caption columns per image: text, anchor, alignment, size in pixels and colour.
    Glyphs are not drawn; the anchor is where the aligned edge of the text goes."""
    bad = check_template(text, files.columns)
    if bad:
        raise InvalidField("; ".join(bad))
    spot = position_preset(position, offset, {"h": h, "v": v, "hj": hj, "vj": vj})
    w, hgt = F.col("width"), F.col("height")
    at = lambda o, base: place(length_px(o, base, dpi), "Left", base, F.lit(0))
    return files.select(
        "image_id",
        template(text, set(files.columns)).alias("text"),
        at(spot["h"], w).alias("x"), at(spot["v"], hgt).alias("y"),
        F.lit(spot["hj"]).alias("align_x"), F.lit(spot["vj"]).alias("align_y"),
        length_px(size, F.floor((w + hgt) / F.lit(2)), dpi).alias("size_px"),
        F.lit(color).alias("color"),
    )


def parameter_grid(action: Action, extended: bool = False) -> list[dict[str, str]]:
    """Field texts for every combination of yes/no and choice fields and, when extended,
    low, middle and high of each slider."""
    options = []
    for name, p in action.params.items():
        if p.kind == "bool":
            options.append((name, ["yes", "no"]))
        elif p.kind == "choice":
            options.append((name, list(p.choices)))
        elif p.kind == "slider" and extended:
            options.append((name, [str(int(v)) for v in (p.low, (p.low + p.high) // 2, p.high)]))
    out = [{}]
    for name, vals in options:
        out = [{**o, name: v} for o in out for v in vals]
    return out
