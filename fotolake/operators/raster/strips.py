"""Raster operators on packed strips: one row per strip of an image instead of one per pixel.

A strip is ``image_id, strip, y0, rows, width, height, bands, data``: whole lines, ``data``
the bytes by line, pixel and band (3 or 4).  All strips of an image but the last have
``lines_of(width)`` lines, about core.STRIP pixels, so an image of any size is many rows.

* Tone and colour: a chain of steps is one vectorised pass, without a shuffle.
* Neighbourhoods: each strip sends the lines that its neighbours need to them; strips of
  one image only meet, in one shuffle of packed bytes for all repeats.  Images of a single
  strip never move.
* Turns, shifts and crops: each strip sends blocks to the strips of its target.

Values are those of the pixel operators: blends and divisions floor in double.  A table
without rows gives none; widths and heights that become 0 give no strips.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from ...functions.pixels import rgb_of
from ..skew import salted_lookup
from . import core
from .neighbourhood import KEEP_ALPHA, KERNELS

FIELDS = ("strip", "y0", "rows", "width", "height", "bands", "data")
_KINDS = {**dict.fromkeys(FIELDS, IntegerType()), "data": BinaryType()}
_ARROW = {**dict.fromkeys(FIELDS, pa.int32()), "data": pa.binary()}
#: Bytes of strips in a result's batch.
BATCH = 16 << 20

#: Takes and gives lines x width x bands bytes; a step may also use a per-image fact.
Step = Callable[..., np.ndarray]


def lines_of(width: int) -> int:
    """Lines of a full strip."""
    return max(1, core.STRIP // max(1, width))


def _last(width: Column, height: Column) -> Column:
    """Number of an image's last strip."""
    lines = F.greatest(F.floor(F.lit(core.STRIP) / F.greatest(width, F.lit(1))), F.lit(1))
    return F.floor((height - 1) / lines).cast("int")


def _schema(df: DataFrame, *more: str) -> StructType:
    """Fields of a strip table with the ids of ``df``, and more whole numbers."""
    return StructType([df.schema["image_id"], *(StructField(n, k) for n, k in _KINDS.items()), *(StructField(n, IntegerType()) for n in more)])


def _array(data: bytes, rows: int, width: int, bands: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(rows, width, bands)


class _Out:
    """Collects result rows into batches of bounded size."""

    def __init__(self, id_type: pa.DataType) -> None:
        self.id_type, self.rows, self.held = id_type, [], 0

    def add(self, image_id, strip: int, y0: int, a: np.ndarray, height: int) -> Iterator[pa.RecordBatch]:
        data = np.ascontiguousarray(a).tobytes()
        self.rows.append((image_id, strip, y0, a.shape[0], a.shape[1], height, a.shape[2], data))
        self.held += len(data) + 64
        if self.held >= BATCH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = list(zip(*self.rows))
            arrays = [pa.array(columns[0], self.id_type), *(pa.array(c, _ARROW[n]) for n, c in zip(FIELDS, columns[1:]))]
            self.rows, self.held = [], 0
            yield pa.RecordBatch.from_arrays(arrays, ["image_id", *FIELDS])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches; bytes are not copied."""
    for b in batches:
        plain = [c.to_pylist() if b.schema.field(i).name != "data" else c for i, c in enumerate(b.columns)]
        at = b.schema.get_field_index("data")
        for i in range(b.num_rows):
            yield tuple(c[i] if k != at else c[i].as_buffer() for k, c in enumerate(plain))


# ---- from and to other forms ----

def from_arrays(rasters: DataFrame) -> DataFrame:
    """Strips of image_id, width, height and one array per band (r, g, b and a, or without a)."""
    bands = [c for c in "rgba" if c in rasters.columns]
    src = rasters.select("image_id", "width", "height", *bands)

    def run(batches):
        for b in batches:
            out = _Out(b.schema.field(0).type)
            flat = [c.flatten().to_numpy() for c in b.columns[3:]]
            starts = np.concatenate([[0], np.cumsum(b.column(3).value_lengths().to_numpy())])
            for i, (image_id, w, h) in enumerate(zip(*(c.to_pylist() for c in b.columns[:3]))):
                a = np.stack([f[starts[i]:starts[i + 1]].astype(np.uint8) for f in flat], -1).reshape(h, w, len(flat))
                for k, y0 in enumerate(range(0, h, lines_of(w))):
                    yield from out.add(image_id, k, y0, a[y0:y0 + lines_of(w)], h)
            yield from out.flush()

    return src.mapInArrow(run, _schema(src))


def from_images(images: DataFrame) -> DataFrame:
    """Strips of decoded images (``path`` and the image source's columns), colour bands first to last; grey becomes three bands."""
    valid = images.filter(F.col("width") > 0).select(F.col("path").alias("image_id"), "width", "height", "nChannels", "data")

    def run(batches):
        for b in batches:
            out = _Out(pa.string())
            for image_id, w, h, n, data in _rows([b]):
                a = _array(data, h, w, n)
                # stored blue first
                a = a[:, :, {1: [0, 0, 0], 2: [0, 0, 0, 1], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[n]]
                for k, y0 in enumerate(range(0, h, lines_of(w))):
                    yield from out.add(image_id, k, y0, a[y0:y0 + lines_of(w)], h)
            yield from out.flush()

    return valid.mapInArrow(run, _schema(valid))


def from_pixels(pixels: DataFrame) -> DataFrame:
    """Strips of a pixel table: one shuffle."""
    packed = core.pack_strips(pixels).select("image_id", *FIELDS)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("data")
            data = [bytes(np.asarray(x.values, np.uint8)) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*(c.cast(_ARROW[n]) if n != "image_id" else c for n, c in zip(b.schema.names[:-1], b.columns[:-1])), pa.array(data, pa.binary())], b.schema.names)

    return packed.mapInArrow(run, _schema(packed))


def to_pixels(strips: DataFrame) -> DataFrame:
    """The pixel table, made by the batch; no generator in the plan."""
    schema = StructType([strips.schema["image_id"], *(StructField(c, IntegerType()) for c in core.COLUMNS[1:])])

    def table(held: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        sizes = [r[3] * r[4] for r in held]
        ids = pa.array([r[0] for r in held], id_type).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
        each = lambda k: np.repeat(np.array([r[k] for r in held], np.int32), sizes)
        x = np.concatenate([np.tile(np.arange(r[4], dtype=np.int32), r[3]) for r in held])
        y = np.concatenate([np.repeat(np.arange(r[2], r[2] + r[3], dtype=np.int32), r[4]) for r in held])
        bands = [_array(r[7], r[3] * r[4], 1, r[6])[:, 0] for r in held]
        colours = [np.concatenate([b[:, i] for b in bands]).astype(np.int32) for i in range(3)]
        none = np.repeat([r[6] < 4 for r in held], sizes)
        alpha = np.concatenate([b[:, 3] if b.shape[1] == 4 else np.zeros(len(b), np.uint8) for b in bands]).astype(np.int32)
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, (each(4), each(5), x, y, *colours)), pa.array(alpha, mask=none)], list(core.COLUMNS))

    def run(batches):
        for b in batches:
            id_type, held, size = b.schema.field("image_id").type, [], 0
            for row in _rows([b]):
                held.append(row)
                size += row[3] * row[4]
                if size >= core.STRIP:
                    yield table(held, id_type)
                    held, size = [], 0
            if held:
                yield table(held, id_type)

    return strips.select("image_id", *FIELDS).mapInArrow(run, schema)


# ---- tone and colour: chains of steps in one pass ----

def _toward(a: np.ndarray, values, amount: float) -> np.ndarray:
    """Blend the colour bands toward ``values``; alpha stays."""
    out = a.copy()
    if amount == 100:
        out[:, :, :3] = values
    else:
        c = a[:, :, :3].astype(np.float64)
        out[:, :, :3] = np.floor(c + (values - c) * (float(amount) / 100.0))
    return out


def _luma(a: np.ndarray) -> np.ndarray:
    c = a.astype(np.int32)
    return (c[:, :, 0] * 299 + c[:, :, 1] * 587 + c[:, :, 2] * 114) // 1000


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x), 0, 255)


def invert(amount=100) -> Step:
    return lambda a: _toward(a, 255 - a[:, :, :3], amount)


def brightness(amount=50) -> Step:
    if amount == 0:
        return lambda a: a
    return lambda a: _toward(a, 0 if amount < 0 else 255, abs(amount))


def contrast(amount=50) -> Step:
    """Above zero toward pure bands; below it toward the image's mean luma, which ``chain`` finds."""
    if amount == 0:
        return lambda a: a
    if amount > 0:
        return lambda a: _toward(a, np.where(a[:, :, :3] > 128, 255, 0), amount)

    def toward_mean(a, mean):
        return _toward(a, mean, -amount)

    toward_mean.fact = "mean"
    return toward_mean


def saturation(amount=-100) -> Step:
    if amount == 0:
        return lambda a: a

    def step(a):
        grey = _luma(a)[:, :, None]
        if amount > 0:
            part = np.floor(grey * 0.7)
            grey = _bytes(np.maximum(a[:, :, :3] - part, 0) / 0.3)
        return _toward(a, grey, abs(amount))

    return step


def desaturate(amount=100) -> Step:
    return lambda a: _toward(a, _luma(a)[:, :, None], amount)


def solarize(threshold=128, amount=100) -> Step:
    return lambda a: _toward(a, np.where(a[:, :, :3] < threshold, a[:, :, :3], 255 - a[:, :, :3]), amount)


def posterize(bits=1, amount=100) -> Step:
    mask = np.uint8(255 & ~(2 ** (8 - bits) - 1))
    return lambda a: _toward(a, a[:, :, :3] & mask, amount)


def colorize(black="#735710", white="#FFFFFF", amount=100) -> Step:
    low, high = np.array(rgb_of(black)), np.array(rgb_of(white))
    return lambda a: _toward(a, _bytes(low + _luma(a)[:, :, None] * (high - low).astype(float) / 255.0), amount)


def warm_up(midtone="#805d40", brighten=50, amount=50) -> Step:
    k = np.array([4.0 * (m / 255.0 - 0.5 + brighten / 600.0) / 255.0 for m in rgb_of(midtone)])

    def step(a):
        i = _luma(a)[:, :, None]
        return _toward(a, _bytes(k * (255 - i) * i + i), amount)

    return step


def color_to_alpha(color="#FFFFFF") -> Step:
    k = np.array(rgb_of(color), float)

    def step(a):
        v = a[:, :, :3].astype(float)
        up = np.where(k < 255, (v - k) / np.where(k < 255, 255.0 - k, 1.0), 0.0)
        down = np.where(k > 0, (k - v) / np.where(k > 0, k, 1.0), 0.0)
        t = np.maximum(up, down).max(2)[:, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            colours = np.where(t > 0, _bytes((v - k) / t + k), v)
        alpha = a[:, :, 3:].astype(float) if a.shape[2] == 4 else np.full(t.shape, 255.0)
        return np.concatenate([colours, _bytes(alpha * t)], 2).astype(np.uint8)

    return step


def convert_mode(mode: str) -> Step:
    """``1``, ``L``, ``LA``, ``RGB`` and ``RGBA`` keep the bands' meaning."""
    def step(a):
        colours = a[:, :, :3]
        if mode in ("1", "L", "LA"):
            grey = _luma(a).astype(np.uint8)
            grey = np.where(grey >= 128, 255, 0).astype(np.uint8) if mode == "1" else grey
            colours = np.repeat(grey[:, :, None], 3, 2)
        if mode in ("LA", "RGBA"):
            alpha = a[:, :, 3:] if a.shape[2] == 4 else np.full((*a.shape[:2], 1), 255, np.uint8)
            return np.concatenate([colours, alpha], 2)
        return colours

    if mode not in ("1", "L", "LA", "RGB", "RGBA"):
        raise ValueError(f"unknown mode {mode!r}")
    return step


def reduce_opacity(opacity=100) -> Step:
    def step(a):
        alpha = a[:, :, 3:] if a.shape[2] == 4 else np.full((*a.shape[:2], 1), 255)
        return np.concatenate([a[:, :, :3], np.floor(alpha * float(opacity) / 100.0)], 2).astype(np.uint8)

    return step


def _mapped(strips: DataFrame, steps: list[Step], facts: list[str]) -> DataFrame:
    columns = ["image_id", *FIELDS, *facts]

    def run(batches):
        for b in batches:
            out = _Out(b.schema.field(0).type)
            for image_id, k, y0, rows, w, h, n, data, *known in _rows([b]):
                a = _array(data, rows, w, n)
                for step in steps:
                    a = step(a, *known) if hasattr(step, "fact") else step(a)
                yield from out.add(image_id, k, y0, a, h)
            yield from out.flush()

    return strips.select(*columns).mapInArrow(run, _schema(strips))


def mean_luma(strips: DataFrame) -> DataFrame:
    """image_id and the floor of the mean luma: a sum from each strip."""
    kinds = StructType([strips.schema["image_id"], StructField("total", LongType()), StructField("n", LongType())])

    def run(batches):
        for b in batches:
            found = [(r[0], int(_luma(_array(r[7], r[3], r[4], r[6])).sum()), r[3] * r[4]) for r in _rows([b])]
            if found:
                ids, total, n = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(total, pa.int64()), pa.array(n, pa.int64())], ["image_id", "total", "n"])

    sums = strips.select("image_id", *FIELDS).mapInArrow(run, kinds)
    mean = F.floor(F.sum("total").cast("double") / F.sum("n")).cast("int")
    return sums.groupBy("image_id").agg(mean.alias("mean"))


def chain(strips: DataFrame, *steps: Step) -> DataFrame:
    """All steps in one pass over each strip.  A step toward the mean needs the image as it is before: the chain is cut there."""
    done: list[Step] = []
    out = strips
    for step in steps:
        if hasattr(step, "fact"):
            out = _mapped(out, done, []) if done else out
            met = salted_lookup(out, mean_luma(out), ["image_id"], F.col("strip"))
            out, done = _mapped(met, [step], ["mean"]), []
        else:
            done.append(step)
    return _mapped(out, done, []) if done else out


# ---- blocks sent from strip to strip ----

def _assembled(pieces: DataFrame, finish: Callable[[np.ndarray, int, int, int], tuple[np.ndarray, int]]) -> DataFrame:
    """pieces(image_id, strip, y0, rows, width, height, bands, data, x0, tw) of a strip meet; ``finish(lines, first line, strip,
    height)`` gives the strip's lines and the first one's place."""
    def run(batches):
        out, id_type = None, None

        def keyed():
            nonlocal id_type, out
            for b in batches:
                id_type = b.schema.field(0).type
                out = out or _Out(id_type)
                yield from _rows([b])

        for (image_id, strip), own in groupby(keyed(), key=lambda r: (r[0], r[1])):
            own = [(r[2], r[8], _array(r[7], r[3], r[4], r[6]), r[5], r[9]) for r in own]
            first, end = min(p[0] for p in own), max(p[0] + p[2].shape[0] for p in own)
            whole = np.empty((end - first, own[0][4], own[0][2].shape[2]), np.uint8)
            for y0, x0, a, _, _ in own:
                whole[y0 - first:y0 - first + a.shape[0], x0:x0 + a.shape[1]] = a
            a, y0 = finish(whole, first, strip, own[0][3])
            yield from out.add(image_id, strip, y0, a, own[0][3])
        if out:
            yield from out.flush()

    placed = pieces.repartition("image_id", "strip").sortWithinPartitions("image_id", "strip")
    return placed.select("image_id", *FIELDS, "x0", "tw").mapInArrow(run, _schema(pieces))


def _pieces(strips: DataFrame, cut: Callable[..., Iterator[tuple[int, int, int, int, int, np.ndarray]]], facts: list[str] = []) -> DataFrame:
    """``cut(array, strip, y0, width, height, *facts)`` yields target strip, y0, x0, target width and height, block."""
    kinds = _schema(strips, "x0", "tw")

    def run(batches):
        for b in batches:
            rows, held = [], 0
            for image_id, k, y0, n_rows, w, h, n, data, *known in _rows([b]):
                for strip, ty, tx, tw, th, a in cut(_array(data, n_rows, w, n), k, y0, w, h, *known):
                    rows.append((image_id, strip, ty, a.shape[0], a.shape[1], th, a.shape[2], np.ascontiguousarray(a).tobytes(), tx, tw))
                    held += len(rows[-1][7])
                    if held >= BATCH:
                        yield _piece_batch(rows, b.schema.field(0).type)
                        rows, held = [], 0
            if rows:
                yield _piece_batch(rows, b.schema.field(0).type)

    return strips.select("image_id", *FIELDS, *facts).mapInArrow(run, kinds)


def _piece_batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    arrays = [pa.array(columns[0], id_type), *(pa.array(c, _ARROW.get(n, pa.int32())) for n, c in zip((*FIELDS, "x0", "tw"), columns[1:]))]
    return pa.RecordBatch.from_arrays(arrays, ["image_id", *FIELDS, "x0", "tw"])


def _split(strips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strips that are a whole image, and those of larger images."""
    single = _last(F.col("width"), F.col("height")) == 0
    return strips.filter(single), strips.filter(~single)


# ---- neighbourhoods ----

#: Takes lines with ``radius`` more on each side (also left and right), gives the lines.
Window = Callable[[np.ndarray], np.ndarray]


def _shifts(padded: np.ndarray, size: int) -> list[np.ndarray]:
    """The size * size neighbours of each pixel, by line and column."""
    h, w = padded.shape[0] - size + 1, padded.shape[1] - size + 1
    return [padded[j:j + h, i:i + w] for j in range(size) for i in range(size)]


def _extreme(size: int, best) -> Window:
    def step(p):
        h, w = p.shape[0] - size + 1, p.shape[1] - size + 1
        lines = p[:, :w]
        for i in range(1, size):
            lines = best(lines, p[:, i:i + w])
        out = lines[:h]
        for j in range(1, size):
            out = best(out, lines[j:j + h])
        return out

    return step


def _median_3(p: np.ndarray) -> np.ndarray:
    """Of nine, by least and greatest alone: columns sorted, then the middle of highest least, middle middle, least greatest."""
    h, w = p.shape[0] - 2, p.shape[1] - 2
    a, b, c = p[:h], p[1:h + 1], p[2:h + 2]
    low, high = np.minimum(a, b), np.maximum(a, b)
    least, middle, most = np.minimum(low, c), np.maximum(low, np.minimum(high, c)), np.maximum(high, c)

    def of(x):
        return x[:, :w], x[:, 1:w + 1], x[:, 2:w + 2]

    def mid(x, y, z):
        return np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))

    (a, b, c), (d, e, f), (g, h_, i) = of(least), of(middle), of(most)
    return mid(np.maximum(np.maximum(a, b), c), mid(d, e, f), np.minimum(np.minimum(g, h_), i))


def _ranked(size: int, index: int) -> Window:
    if index in (0, size * size - 1):
        return _extreme(size, np.maximum if index else np.minimum)
    if (size, index) == (3, 4):
        return _median_3
    return lambda p: np.partition(np.stack(_shifts(p, size)), index, axis=0)[index]


def _commonest(size: int) -> Window:
    """Most common value, the smallest of equals."""
    def step(p):
        near = _shifts(p, size)
        best = None
        for v in near:
            n = np.zeros(v.shape, np.int32)
            for other in near:
                n += v == other
            key = n * 256 + (255 - v.astype(np.int32))
            best = key if best is None else np.maximum(best, key)
        return (255 - best % 256).astype(np.uint8)

    return step


def _kernel(name: str) -> Window:
    weights, divisor, offset = KERNELS[name]
    size = 5 if len(weights) == 25 else 3

    def step(p):
        total = None
        for w, v in zip(weights, _shifts(p, size)):
            if w:
                part = v.astype(np.int32) * w
                total = part if total is None else total + part
        return np.clip(np.floor(total / float(divisor)) + offset, 0, 255).astype(np.uint8)

    return step


def filtered(strips: DataFrame, window: Window, size: int, bands: int = 4, repeat: int = 1, amount=100) -> DataFrame:
    """A square filter on the first ``bands`` bands, ``repeat`` times, blended at ``amount`` percent each time.  Beyond the
    border the edge pixel is repeated."""
    r = size // 2
    halo = r * repeat

    def applied(a: np.ndarray, top: int, height: int) -> tuple[np.ndarray, int]:
        """Lines from ``top`` on, as far as the lines around them reach; at the image's border it is repeated in each round."""
        bottom = top + len(a)
        for _ in range(repeat):
            at_top, at_bottom = top == 0, bottom == height
            p = np.pad(a, ((r if at_top else 0, r if at_bottom else 0), (r, r), (0, 0)), "edge")
            own = a[0 if at_top else r: len(a) - (0 if at_bottom else r)]
            new = window(p[:, :, :bands])
            if amount < 100:
                c = own[:, :, :bands].astype(float)
                new = np.floor(c + (new - c) * (float(amount) / 100.0)).astype(np.uint8)
            a = np.concatenate([new, own[:, :, bands:]], 2) if bands < own.shape[2] else new
            top, bottom = top if at_top else top + r, bottom if at_bottom else bottom - r
        return a, top

    whole, parts = _split(strips)

    def single(a):
        return applied(a, 0, len(a))[0]

    def cut(a, k, y0, w, h):
        lines = lines_of(w)
        for strip in range(max(0, (y0 - halo) // lines), min((h - 1) // lines, (y0 + len(a) - 1 + halo) // lines) + 1):
            top, end = max(strip * lines - halo, y0), min(min((strip + 1) * lines, h) + halo, y0 + len(a))
            if top < end:
                yield strip, top, 0, w, h, a[top - y0:end - y0]

    def finish(a, first, strip, height):
        start = strip * lines_of(a.shape[1])
        out, top = applied(a, first, height)
        return out[start - top:min(start + lines_of(a.shape[1]), height) - top], start

    return _mapped(whole, [single], []).unionByName(_assembled(_pieces(parts, cut), finish))


def minimum(strips: DataFrame, size=3, amount=100) -> DataFrame:
    return filtered(strips, _extreme(size, np.minimum), size, amount=amount)


def maximum(strips: DataFrame, size=3, amount=100) -> DataFrame:
    return filtered(strips, _extreme(size, np.maximum), size, amount=amount)


def median(strips: DataFrame, size=3, amount=100) -> DataFrame:
    return filtered(strips, _ranked(size, size * size // 2), size, amount=amount)


def rank(strips: DataFrame, size=3, rank=50, amount=100) -> DataFrame:
    return filtered(strips, _ranked(size, int((size * size - 1) * rank / 100.0)), size, amount=amount)


def common(strips: DataFrame, size=3, amount=100) -> DataFrame:
    return filtered(strips, _commonest(size), size, amount=amount)


def effect(strips: DataFrame, kernel="blur", amount=100, repeat=1) -> DataFrame:
    """Convolution by name, repeated and blended each time."""
    size = 5 if len(KERNELS[kernel][0]) == 25 else 3
    return filtered(strips, _kernel(kernel), size, 3 if kernel in KEEP_ALPHA else 4, repeat, amount)


def sketch(strips: DataFrame, details=1) -> DataFrame:
    """Pencil drawing: luma divided by its blurred negative."""
    def negative(a):
        grey = _luma(a)
        return np.stack([255 - grey, grey, grey], 2).astype(np.uint8)

    def divided(a):
        c = a.astype(np.int32)
        v = np.minimum(np.floor(c[:, :, 1] * 255 / (256 - c[:, :, 0])), 255)
        return np.repeat(v[:, :, None], 3, 2).astype(np.uint8)

    return chain(filtered(chain(strips, negative), _kernel("blur"), 5, 1, details), divided)


# ---- turns, shifts and crops ----

def _turned(a: np.ndarray, method: str) -> np.ndarray:
    flips = {"NONE": a, "FLIP_LEFT_RIGHT": a[:, ::-1], "FLIP_TOP_BOTTOM": a[::-1], "ROTATE_180": a[::-1, ::-1]}
    if method in flips:
        return flips[method]
    t = a.transpose(1, 0, 2)
    return {"TRANSPOSE": t, "ROTATE_90": t[::-1], "ROTATE_270": t[:, ::-1], "TRANSVERSE": t[::-1, ::-1]}[method]


def _dealt(a: np.ndarray, y0: int, x0: int, tw: int, th: int) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """A block of the target, cut at the target's strips."""
    lines, at = lines_of(tw), y0
    while at < y0 + len(a):
        strip = at // lines
        end = min(y0 + len(a), (strip + 1) * lines)
        yield strip, at, x0, tw, th, a[at - y0:end - y0]
        at = end


def moved(strips: DataFrame, place: Callable[..., Iterator[tuple[int, int, int, int, np.ndarray]]], facts: list[str] = []) -> DataFrame:
    """``place(array, y0, width, height, *facts)`` yields blocks of the target: y0, x0, target width and height, block."""
    def cut(a, k, y0, w, h, *known):
        for ty, tx, tw, th, block in place(a, y0, w, h, *known):
            yield from _dealt(block, ty, tx, tw, th)

    return _assembled(_pieces(strips, cut, facts), lambda a, first, strip, height: (a, first))


def _turn(a, y0, w, h, method):
    t = _turned(a, method)
    n = len(a)
    low = h - y0 - n
    if method in ("NONE", "FLIP_LEFT_RIGHT"):
        yield y0, 0, w, h, t
    elif method in ("FLIP_TOP_BOTTOM", "ROTATE_180"):
        yield low, 0, w, h, t
    else:
        yield 0, y0 if method in ("TRANSPOSE", "ROTATE_90") else low, h, w, t


def transpose(strips: DataFrame, method: str) -> DataFrame:
    """Flip or turn by quarter turns."""
    if method in ("NONE", "FLIP_LEFT_RIGHT"):  # lines stay where they are
        return chain(strips, lambda a: _turned(a, method))
    return moved(strips, lambda a, y0, w, h: _turn(a, y0, w, h, method))


def orient(strips: DataFrame, orientation: Column) -> DataFrame:
    """Turn each image upright by its own orientation tag."""
    from .geometry import UPRIGHT

    tagged = strips.withColumn("tag", orientation.cast("int"))
    return moved(tagged, lambda a, y0, w, h, tag: _turn(a, y0, w, h, UPRIGHT.get(tag, "NONE")), ["tag"])


def offset(strips: DataFrame, h: int, v: int) -> DataFrame:
    """Shift with wrap-around."""
    def place(a, y0, width, height):
        a = np.roll(a, h, 1)
        start, n = (y0 + v) % height, len(a)
        over = max(0, start + n - height)
        yield start, 0, width, height, a[:n - over]
        if over:
            yield 0, 0, width, height, a[n - over:]

    return moved(strips, place)


def crop(strips: DataFrame, left=0, right=0, top=0, bottom=0) -> DataFrame:
    """Cut lines and columns off the sides."""
    def place(a, y0, w, h):
        tw, th = w - left - right, h - top - bottom
        first, end = max(y0, top), min(y0 + len(a), h - bottom)
        if tw > 0 and first < end:
            yield first - top, 0, tw, th, a[first - y0:end - y0, left:w - right]

    return moved(strips, place)
