"""The registry of actions an action list can name.

An action is a label, its fields, and a function on a pixel table or on the file table.
Field values arrive as Python values or, when they depend on the image, as columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.units import position_preset
from ..operators import tags as T
from ..operators.raster import composite as K, core, geometry as G, histogram as H, mosaic as M
from ..operators.raster import neighbourhood as N, pointwise as P
from .params import (Param, amount, choice, color, height, length, mean_side, slider, text, true_mean_side, width,
                     yes_no)


@dataclass(frozen=True)
class Action:
    label: str
    on: str                      # pixels, files, caption or output
    params: dict[str, Param]     # by argument name
    fn: Callable | None = None
    stamp: str | None = None     # field that names a stamp image
    valid_last: bool = False


ACTIONS: dict[str, Action] = {}


def register(label: str, fn: Callable[..., DataFrame], on: str = "pixels", stamp: str | None = None,
             valid_last: bool = False, **params: Param) -> None:
    """Add an action: ``fn(DataFrame, **params) -> DataFrame``."""
    ACTIONS[label] = Action(label, on, params, fn, stamp, valid_last)


def register_raster(label: str, fn: Callable[..., np.ndarray], halo: int = 0, **params: Param) -> None:
    """Add an action given as numpy code that keeps the image size.

    ``fn(array lines x width x 4, **params)`` gets a block of lines with ``halo`` more on
    each side where the image has them; a task never holds a whole large image."""

    def apply(df: DataFrame, **kw) -> DataFrame:
        def block(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["y", "x"])
            w = int(pdf["width"].iloc[0])
            none = pdf["a"].isna().to_numpy()
            a = pdf[["r", "g", "b", "a"]].fillna(255).to_numpy(np.uint8).reshape(-1, w, 4)
            out = np.clip(np.asarray(fn(a, **kw)), 0, 255).astype(np.int64).reshape(-1, 4)
            for i, c in enumerate(("r", "g", "b", "a")):
                pdf[c] = out[:, i]
            pdf["a"] = pdf["a"].astype("Int64").mask(none)
            return pdf[pdf["y"] // N.BLOCK == key[1]].drop(columns="_block")

        blocks = N._blocks(df.select(*core.COLUMNS), halo)
        return blocks.groupBy("image_id", "_block").applyInPandas(block, df.select(*core.COLUMNS).schema)

    register(label, apply, **params)


# Mode names in action lists.
MODES = {
    "Monochrome (1-bit pixels, black and white)": "1",
    "Grayscale (8-bit pixels)": "L",
    "LA (8-bit pixels, grayscale with transparency mask)": "LA",
    "RGB (3x8-bit pixels, true color)": "RGB",
    "RGBA (4x8-bit pixels, RGB with transparency mask)": "RGBA",
    "P (8-bit pixels, mapped using a color palette)": "P",
    "CMYK (4x8-bit pixels, color separation)": "CMYK",
    "YCbCr (3x8-bit pixels, color video format)": "YCbCr",
}
TURNS = ("Rotate 90", "Rotate 180", "Rotate 270", "Flip Left Right", "Flip Top Bottom")
RESAMPLE = ("nearest", "bilinear", "bicubic", "antialias")


def turn_code(name: str) -> str:
    """``Flip Left Right`` to FLIP_LEFT_RIGHT; ``Normal`` and ``None`` to NONE."""
    return "NONE" if name in ("Normal", "None") else name.upper().replace(" ", "_")


def _resampling(label="Resample Image"):
    return choice(label, "automatic", "automatic", *RESAMPLE)


def _dpi():
    return Param("Resolution", "dpi", "<dpi>")


def _window():
    return {"size": Param("Radius", "int", "3", 3, 5, (3, 5))}


def _position():
    return {
        "orientation": choice("Orientation", "Normal", "Normal", *TURNS),
        "position": choice("Position", "Center", "Center", "Bottom Left", "Bottom Right", "Top Left", "Top Right", "Custom"),
        "offset": text("Offset", "5%"), "h": text("Horizontal Offset", "50%"), "v": text("Vertical Offset", "50%"),
        "hj": choice("Horizontal Justification", "Middle", "Left", "Middle", "Right"),
        "vj": choice("Vertical Justification", "Middle", "Top", "Middle", "Bottom"),
    }


def _where(kw: dict) -> dict:
    """Offsets and justifications from the position fields."""
    orientation = kw.pop("orientation", "Normal")
    spot = position_preset(kw.pop("position"), kw.pop("offset"), {k: kw[k] for k in ("h", "v", "hj", "vj")})
    for k in ("h", "v", "hj", "vj"):
        kw.pop(k)
    return {"turn": turn_code(orientation), **spot}


def _watermark(df, stamp, method, opacity, **kw):
    spot = _where(kw)
    turn = spot.pop("turn")
    if method == "By Offset" and turn != "NONE":
        stamp = K.Stamp.of(stamp.pixels, turn)
    return K.watermark(df, stamp, method, opacity, **spot)


def _background(df, stamp, fill, color, method, opacity, **kw):
    if fill == "Color":
        return K.background(df, color, opacity)
    spot = _where(kw)
    turn = spot.pop("turn")
    if method == "By Offset" and turn != "NONE":
        stamp = K.Stamp.of(stamp.pixels, turn)
    return K.background(df, opacity=opacity, stamp=stamp, method=method, **spot)


def _transpose(df, method, amount):
    if method == "Orientation":
        # the runner adds the tags; images without the tag, or with another value, are upright
        return G.orient(df, F.try_element_at("tags", F.lit("Exif_Image_Orientation")).try_cast("int")) if "tags" in df.columns else df
    return G.transpose(df, turn_code(method), amount)


def _perspective(df, projection, scale, left, top, bottom, right, off_x, off_y, turn, color, opacity, method, crop):
    user = None
    if projection == "User":
        user = (scale, left, top, bottom, right, off_x, off_y, turn_code(turn))
    return G.perspective(df, projection, color, opacity, crop, user, "nearest" if method == "nearest" else "linear")


def _border(df, method, width, left, right, top, bottom, color, opacity):
    if method == "Equal for all sides":
        return K.border(df, width, color=color, opacity=opacity)
    return K.border(df, left=left, right=right, top=top, bottom=bottom, color=color, opacity=opacity)


def _round(df, radius, same, method, tl, tr, bl, br, color, opacity):
    return K.round_corners(df, radius, method, None if same else (tl, tr, bl, br), opacity, color)


def _scale(df, w, h, dpi, constrain, method, down_only):
    return G.scale(df, w, h, constrain, method, down_only)


def _fit(df, w, h, dpi, ah, av, bleed, method):
    return G.fit(df, w, h, ah, av, bleed, method)


def _canvas(df, w, h, dpi, ah, av, color, opacity):
    return G.canvas(df, w, h, ah, av, color, opacity)


def _tamogen(df, stamp, cols, rows, **kw):
    """The fill is a stamp table: one image, or a folder's images by image_id."""
    return M.mosaic(df, stamp.pixels, cols, rows)


AMOUNT = {"amount": amount()}
register("Invert", P.invert, **AMOUNT)
register("Brightness", P.brightness, amount=slider("Amount", 50, -100, 100))
register("Contrast", P.contrast, amount=slider("Amount", 50, -100, 100))
register("Saturation", P.saturation, amount=slider("Amount", -100, -100, 100))
register("Desaturate", P.desaturate, **AMOUNT)
register("Solarize", P.solarize, threshold=slider("Treshold", 128, 0, 255), **AMOUNT)
register("Posterize", P.posterize, bits=slider("Bits", 1, 0, 8), **AMOUNT)
register("Colorize", P.colorize, black=color("Black", "#735710"), white=color("White", "#FFFFFF"), **AMOUNT)
register("Warm Up", P.warm_up, midtone=color("Midtone", "#805d40"), brighten=slider("Brighten", 50, 0, 100),
         amount=amount(50))
register("Color to Alpha", P.color_to_alpha,
         select=choice("Select Color By", "Value", "Value", *P.CORNERS), color=color("Color Value", "#FFFFFF"))
register("Convert Mode", lambda df, mode: P.as_shown(df, MODES[mode]),
         mode=choice("Mode", list(MODES)[4], *MODES))
register("Auto Contrast", H.autocontrast, cutoff=slider("Cutoff", 0, 0, 100), **AMOUNT)
register("Equalize", H.equalize, **AMOUNT)
register("Transpose", _transpose, method=choice("Method", "Orientation", "Orientation", *TURNS),
         amount=slider("Amount", 100, 1, 100))
register("Crop", G.crop, mode=choice("Mode", "All", "All", "Auto", "Custom"), all=length("All", "30%", mean_side),
         left=length("Left", "0px", width), right=length("Right", "0px", width),
         top=length("Top", "0px", height), bottom=length("Bottom", "0px", height))
register("Offset", G.offset, h=length("Horizontal Offset", "50%", width), v=length("Vertical Offset", "50%", height))
register("Mirror", G.mirror, direction=choice("Direction", "Both", "Both", "Horizontal", "Vertical"))
register("Grid", G.grid, cols=slider("Columns", 2, 1, 10), rows=slider("Rows", 2, 1, 10),
         scale=yes_no("Scale to Keep Size", False), col_line=length("Column Line Width", "0 px", height),
         row_line=length("Row Line Width", "0 px", width), color=color("Line Color", "#FFFFFF"),
         opacity=slider("Line Opacity", 0, 0, 100))
register("Scale", _scale, w=length("Canvas Width", "800px", width), h=length("Canvas Height", "800px", height),
         dpi=_dpi(), constrain=yes_no("Constrain Proportions", True), method=_resampling(),
         down_only=yes_no("Scale Down Only", False))
register("Fit", _fit, w=length("Canvas Width", "<min(width,height)>", width),
         h=length("Canvas Height", "<min(width,height)>", height), dpi=_dpi(),
         ah=slider("Align Horizontal", 50, 0, 100), av=slider("Align Vertical", 50, 0, 100),
         bleed=slider("Bleed", 0, 0, 100), method=_resampling())
register("Canvas", _canvas, w=length("Canvas Width", "<max(width, height)> px", width),
         h=length("Canvas Height", "<max(width, height)> px", height), dpi=_dpi(),
         ah=slider("Align Horizontal", 50, 0, 100), av=slider("Align Vertical", 50, 0, 100),
         color=color("Background Color", "#FFFFFF"), opacity=slider("Opacity", 0, 0, 100))
register("Rotate", lambda df, angle, method, expand, amount, color, opacity: G.rotate(
             df, angle, "nearest" if method == "nearest" else "bilinear", expand, amount, color, opacity),
         angle=slider("Angle", 45, 1, 360), method=choice("Resample Image", "bicubic", *RESAMPLE[:3]),
         expand=yes_no("Expand", False), amount=slider("Amount", 100, 1, 100), color=color("Background Color", "#000000"),
         opacity=slider("Background Opacity", 0, 0, 100))
register("Perspective", _perspective, projection=choice("Projection", "Left", *G.PERSPECTIVES, "User"),
         scale=slider("Scale", 100, 1, 200), left=slider("Left Shear Angle", 5, -180, 180),
         top=slider("Top Shear Angle", 5, -180, 180), bottom=Param("Bottom Shear Factor", "float", "40"),
         right=Param("Right Shear Factor", "float", "40"),
         off_x=length("Horizontal Offset", "15%", width), off_y=length("Vertical Offset", "5%", height),
         turn=choice("Transpose", "None", "None", *TURNS), color=color("Background Color", "#000000"),
         opacity=slider("Background Opacity", 0, 0, 100), method=choice("Resample Image", "bicubic", *RESAMPLE[:3]), crop=yes_no("Auto Crop", True))
register("Minimum", N.minimum, **_window(), **AMOUNT)
register("Maximum", N.maximum, **_window(), **AMOUNT)
register("Median", N.median, **_window(), **AMOUNT)
register("Rank", N.rank, **_window(), rank=slider("Rank", 50, 0, 100), **AMOUNT)
register("Common", N.common, **_window(), **AMOUNT)
register("Effect", N.effect, kernel=choice("Filter", "blur", *N.KERNELS), repeat=slider("Repeat", 1, 1, 10), **AMOUNT)
register("Sketch", N.sketch, details=Param("Details Degree", "int", "1", 1, None))
register("Watermark", _watermark, stamp="Mark", method=choice("Method", "Scale", "By Offset", "Tile", "Scale"),
         opacity=slider("Opacity", 100, 1, 100), **_position())
register("Background", _background, stamp="Mark", fill=choice("Fill", "Color", "Color", "Image"),
         color=color("Color", "#FFFFFF"), method=choice("Method", "Scale", "By Offset", "Tile", "Scale"),
         opacity=slider("Opacity", 100, 1, 100), **_position())
register("Mask", lambda df, stamp, method: K.mask(df, stamp), stamp="Mask",
         method=choice("Resample Mask", "antialias", *RESAMPLE))
register("Highlight", lambda df, stamp, method, opacity: K.highlight(df, stamp, opacity), stamp="Highlight",
         method=choice("Resample Highlight", "antialias", *RESAMPLE), opacity=slider("Opacity", 100, 0, 100))
register("Border", _border,
         method=choice("Method", "Equal for all sides", "Equal for all sides", "Different for each side"),
         width=length("Border Width", "1px", mean_side), left=length("Left", "0px", width),
         right=length("Right", "0px", width), top=length("Top", "0px", height),
         bottom=length("Bottom", "0px", height), color=color("Color", "#000000"), opacity=slider("Opacity", 100, 1, 100))
register("Contour", lambda df, size, offset, line, fill, opacity, include: K.contour(
             df, size, offset, line, fill, opacity, include),
         size=length("Size", "1px", mean_side), offset=length("Offset", "0px", mean_side),
         line=color("Contour Color", "#000000"), fill=color("Fill Color", "#FFFFFF"),
         opacity=slider("Opacity", 100, 0, 100), include=yes_no("Include image", True))
_CORNER = ("Rounded", "Square", "Cross")
register("Round", _round, radius=length("Radius", "2%", true_mean_side), same=yes_no("Same Method for All Corners", True),
         method=choice("Method", "Rounded", *_CORNER), tl=choice("Top Left Corner", "Rounded", *_CORNER),
         tr=choice("Top Right Corner", "Rounded", *_CORNER), bl=choice("Bottom Left Corner", "Rounded", *_CORNER),
         br=choice("Bottom Right Corner", "Rounded", *_CORNER), color=color("Background Color", "#FFFFFF"),
         opacity=slider("Opacity", 100, 1, 100))
register("Shadow", K.shadow, h=length("Horizontal Offset", "2%", width), v=length("Vertical Offset", "2%", height),
         border=length("Border", "4%", mean_side), blur=slider("Shadow Blur", 3, 1, 20),
         back=color("Background Color", "#FFFFFF"), color=color("Shadow Color", "#444444"),
         force_back=yes_no("Force Background Color", True))
register("Reflection", K.reflection, depth=length("Depth", "10%", height), gap=length("Gap", "0", height),
         opacity=slider("Opacity", 60, 0, 100), blur=yes_no("Blur Reflection", False),
         scale=yes_no("Scale Reflection", False), method=choice("Scale Method", "antialias", *RESAMPLE),
         color=color("Background Color", "#FFFFFF"), back_opacity=slider("Background Opacity", 90, 0, 100))
register("Tamogen", _tamogen, stamp="Fill Image", fill_type=choice("Fill Type", "Image", "Image", "Folder"),
         folder=text("Fill Folder", ""), rows=Param("Rows", "int", "10", 1), cols=Param("Columns", "int", "10", 1),
         cw=length("Canvas Width", "100%", width), ch=length("Canvas Height", "100%", height))
register("Text", None, on="caption", text=text("Text"), font=text("Font"), size=length("Size", "5%", mean_side),
         color=color("Color", "#000000"), **_position())

# ---- tags and files ----

register("Write Tag", lambda df, name, value: T.write_tag(df, name, value), on="files",
         name=Param("Tag (Exif, Iptc)", "tag", "Exif_Image_Copyright"), value=text("Value", ""))
register("Rename Tag", T.rename_tag, on="files", old=Param("From (Exif, Iptc)", "tag", "Exif_Image_ImageDescription"),
         new=Param("To (Exif, Iptc)", "tag", "Exif_Image_ImageDescription"))
register("Delete Tags", T.delete_tags, on="files", method=choice("Method", "All", "All", "Exif", "Iptc", "One"),
         name=Param("Tag", "tag", "Exif_Image_ImageDescription"))
register("Time Shift", T.time_shift, on="files",
         change=choice("Change", "Exif and file", "Exif time", "File time", "Exif and file"),
         use_exif=yes_no("Use exif datetime", True),
         **{k: Param(k.title(), "int", "0", per_image=True) for k in ("seconds", "minutes", "hours", "days", "months", "years")})
register("Geotag", None, on="files", track=text("GPS Data (gpx)", " "), report=text("GPS Report (csv)", " "),
         shift=Param("Time Shift (seconds)", "int", "0"))

_SAVE_OPTIONS = {
    "dpi": _dpi(), "show": yes_no("Show Type Options", False), "png": yes_no("PNG Optimize", False),
    "quality": slider("JPEG Quality", 85, 1, 100), "limit": Param("JPEG Size Maximum", "size", "0 kb"),
    "tolerance": text("JPEG Size Tolerance", "10 kb"), "tiff": text("TIFF Compression", "<compression>"),
    "metadata": yes_no("Metadata", True),
}
register("Save", None, on="output", valid_last=True, name=text("File Name", "<filename>"), type=text("As", "<type>"),
         folder=text("In", "<folder>/<subfolder>"), **_SAVE_OPTIONS)
for _label in ("Copy", "Rename", "Save Tags"):
    register(_label, None, on="output", valid_last=True, name=text("File Name", "<filename>"),
             folder=text("In", "<folder>/<subfolder>"))
