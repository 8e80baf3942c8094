"""Tone mosaic: every section of an image becomes the closest fill image, tone-matched.

The closest fill is an exact nearest neighbour (least sum of absolute differences of the
cell tones).  Equal sections and equal fills are merged beforehand.  Sections are dealt to
tiles and fills to blocks; each tile meets each block in one task, where fills are halved
into leaves along their widest tone.  A section passes over the leaves whose box of tones is
farther away than what it has; only the least of each tile and block leaves the task, so
pairs never stand on disk.

A colour that the section or the fill lacks (NULL in all its pixels) does not count in
their distance; with none in common they never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ...functions.pixels import RGB, floor_byte
from ...session import written
from . import core, geometry as G

FIXED = 16          # tones are kept in 1/16 steps, so all distances are whole numbers
ABSENT = -1         # the tone of a colour that is missing
SALTS = 16          # a popular fill's pixels are spread over this many keys
TILES = 64          # tiles of sections at least, for tasks of like size
SECTIONS, FILLS = 1 << 16, 1 << 18  # features of a tile and of a block, about
LEAF, STEP = 512, 512  # fills of a leaf, and sections that meet one at a time: both fit a core's cache
HOT = 1 << 16       # sections with one feature that are joined by its hash


def _cell_tones(parts: DataFrame, keys: list[str]) -> DataFrame:
    """From rows (keys, cell, k = weight, r, g, b) to one flat feature array: the tones of
    each cell, band by band."""
    sums = parts.groupBy(*keys, "cell").agg(
        F.sum("k").alias("n"), *[F.sum(F.col(c) * F.col("k")).alias(c) for c in RGB])
    tone = F.array(*[F.coalesce(F.floor(F.col(c) * FIXED / F.col("n")).cast("int"), F.lit(ABSENT)) for c in RGB])
    # grid x grid entries per group.
    return sums.groupBy(*keys).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("cell", tone.alias("t")))), lambda s: s["t"])).alias("f"))


def _grid_parts(df: DataFrame, x: Column, y: Column, w: Column, h: Column, grid: int) -> DataFrame:
    """Each pixel's whole-number share in the cells of a grid laid over w x h."""
    def cells(p, n):
        return F.sequence(F.floor(p * grid / n).cast("int"), F.floor(((p + 1) * grid - 1) / n).cast("int"))

    def share(p, n, cell):
        return F.least((p + 1) * grid, (cell + 1) * n) - F.greatest(p * grid, cell * n)

    d = df.withColumns({"_px": x, "_py": y, "_pw": w, "_ph": h})
    px, py, pw, ph = (F.col(c) for c in ("_px", "_py", "_pw", "_ph"))
    d = d.withColumn("_cx", F.explode_outer(cells(px, pw))).withColumn("_cy", F.explode_outer(cells(py, ph)))
    k = share(px, pw, F.col("_cx")) * share(py, ph, F.col("_cy"))
    return d.withColumns({"cell": F.col("_cy") * grid + F.col("_cx"), "k": k.cast("long")})


def section_of(p: Column, size: Column, n: Column) -> Column:
    """Section i covers floor(i * size / n) up to floor((i + 1) * size / n)."""
    return F.floor(((p + 1) * n - 1) / size).cast("int")


def section_start(i: Column, size: Column, n: Column) -> Column:
    return F.floor(i * size / n).cast("int")


def _sectioned(df: DataFrame, cols: int, rows: int) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    cols, rows = F.least(F.lit(cols), w), F.least(F.lit(rows), h)  # a section has at least one pixel
    d = df.withColumns({"col": section_of(F.col("x"), w, cols), "row": section_of(F.col("y"), h, rows)})
    return d.withColumns({
        "x0": section_start(F.col("col"), w, cols), "y0": section_start(F.col("row"), h, rows),
        "sw": section_start(F.col("col") + 1, w, cols) - section_start(F.col("col"), w, cols),
        "sh": section_start(F.col("row") + 1, h, rows) - section_start(F.col("row"), h, rows)})


def _leaves(g: np.ndarray) -> list[np.ndarray]:
    """Numbers of the fills in each leaf, ascending; ``g`` has a line for each tone."""
    todo, out = [np.arange(g.shape[1])], []
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            out.append(np.sort(own))
            continue
        tones = g[:, own]
        half = len(own) // 2
        by = own[np.argpartition(tones[np.ptp(tones, axis=1).argmax()], half)]
        todo += [by[:half], by[half:]]
    return out


def _sums(p: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The distance of each section and fill."""
    out = np.zeros((p.shape[1], g.shape[1]), _total(p.dtype))
    for mine, other in zip(p, g):
        gap = mine[:, None] - other
        out += np.abs(gap, out=gap).view(out.dtype)
    return out


def _total(kind) -> np.dtype:
    return np.dtype(np.uint16 if kind == np.int16 else np.int32)


def closest(p: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each section the least distance and the first fill that has it; lines are tones."""
    # whole sums of tones below 256 * FIXED
    kind = np.int16 if len(p) * 256 * FIXED < 1 << 16 else np.int32
    p, g = np.ascontiguousarray(p, kind), np.ascontiguousarray(g, kind)
    leaves = _leaves(g)
    own = [np.ascontiguousarray(g[:, x]) for x in leaves]
    low, high = (np.stack([fn(x, axis=1) for x in own], 1) for fn in (np.min, np.max))
    known = np.sort([x[len(x) // 2] for x in leaves])
    best, at = np.zeros(p.shape[1], _total(kind)), np.zeros(p.shape[1], np.int64)
    for start in range(0, p.shape[1], STEP):
        part, least, first = p[:, start : start + STEP], best[start : start + STEP], at[start : start + STEP]
        # one fill of each leaf, then the leaves that may hold something closer, or as close and before it
        sums = _sums(part, g[:, known])
        j = sums.argmin(1)
        least[:], first[:] = sums[np.arange(len(j)), j], known[j]
        bound = np.zeros((len(leaves), part.shape[1]), best.dtype)
        for mine, lo, hi in zip(part, low, high):
            out = np.maximum(lo[:, None] - mine, mine - hi[:, None])
            bound += np.maximum(out, 0, out=out).view(bound.dtype)
        for k in np.argsort(bound.sum(1, dtype=np.int64)):
            rows = np.flatnonzero(bound[k] <= least)
            if not len(rows):
                continue
            sums = _sums(part if len(rows) == part.shape[1] else part[:, rows], own[k])
            j = sums.argmin(1)
            found, fill = sums[np.arange(len(j)), j], leaves[k][j]
            better = (found < least[rows]) | (found == least[rows]) & (fill < first[rows])
            least[rows[better]], first[rows[better]] = found[better], fill[better]
    return best, at


def _in_common(p: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``closest`` over the colours that both have; -1 for a section that shares none with any fill."""
    sets = [sum((x[i] != ABSENT).astype(int) << i for i in range(len(RGB))) for x in (p, g)]
    most = np.iinfo(np.int64).max
    best, at = np.full(p.shape[1], most), np.full(p.shape[1], -1)
    for has in np.unique(sets[0]):
        rows = np.flatnonzero(sets[0] == has)
        for other in np.unique(sets[1]):
            tones = [i for i in range(len(p)) if has & other & 1 << i % len(RGB)]
            if not tones:
                continue
            fills = np.flatnonzero(sets[1] == other)
            found, j = closest(p[np.ix_(tones, rows)], g[np.ix_(tones, fills)])
            fill, least = fills[j], best[rows]
            better = (found < least) | (found == least) & (fill < at[rows])
            best[rows[better]], at[rows[better]] = found[better], fill[better]
    return best, at


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows that are equal in the first column, which stand together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        place = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[0].column(0)[0].as_py() != place[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def nearest(sections: DataFrame, fills: DataFrame, grid: int) -> DataFrame:
    """For each distinct feature ``f`` of ``sections`` its number of sections ``n`` and the
    (distance, fill_id) that is least, over the colours that both have; no row where no fill
    has one in common."""
    # Of equal fills the smallest id counts.
    probe = written(sections.groupBy("f").agg(F.count("*").alias("n")), "probe")
    known = written(fills.groupBy("f").agg(F.min("fill_id").alias("fill_id")), "known")
    tiles, blocks = max(TILES, -(-probe.count() // SECTIONS)), max(1, -(-known.count() // FILLS))
    tile, block = (F.pmod(F.xxhash64("f"), F.lit(n)) for n in (tiles, blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast(known.schema["fill_id"].dataType)
    dealt = (
        probe.withColumn("block", every(blocks)).select((tile * blocks + F.col("block")).alias("place"), F.lit(False).alias("fill"), none.alias("fill_id"), "n", "f")
        .unionByName(known.withColumn("tile", every(tiles)).select((F.col("tile") * blocks + block).alias("place"), F.lit(True).alias("fill"), "fill_id", F.lit(0).cast("long").alias("n"), "f"))
    )
    width = len(RGB) * grid * grid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _places(batches):
            n = rows.num_rows - rows["fill"].to_numpy().sum()
            if not 0 < n < rows.num_rows:
                continue
            tones = np.concatenate([c.flatten().to_numpy() for c in rows["f"].chunks]).reshape(-1, width).T
            best, at = _in_common(tones[:, :n], tones[:, n:])
            some = np.flatnonzero(at >= 0)
            ids = rows["fill_id"].combine_chunks()
            # few rows at a time
            for a in range(0, len(some), 10_000):
                own = some[a : a + 10_000]
                mine = rows.select(["f", "n"]).take(pa.array(own)).combine_chunks()
                columns = [*(mine[c].chunk(0) for c in ("f", "n")), pa.array(best[own].astype(np.int32)), ids.take(pa.array(at[own] + n))]
                yield pa.RecordBatch.from_arrays(columns, ["f", "n", "distance", "fill_id"])

    schema = StructType([probe.schema["f"], probe.schema["n"], StructField("distance", IntegerType()), known.schema["fill_id"]])
    found = dealt.repartition(tiles * blocks, "place").sortWithinPartitions("place", "fill", "fill_id").mapInArrow(run, schema)
    if blocks == 1:
        return found
    return found.groupBy("f", "n").agg(F.min(F.struct("distance", "fill_id")).alias("_b")).select("f", "n", "_b.*")


def section_fills(df: DataFrame, fills: DataFrame, cols=10, rows=10, grid=2) -> DataFrame:
    """image_id, width, height, col, row, fill_id, distance for each section; without a fill
    that has a colour in common the last two are NULL."""
    d = _sectioned(df, cols, rows)
    x, y = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    keys = ["image_id", "width", "height", "col", "row", "x0", "y0", "sw", "sh"]
    sections = written(_cell_tones(_grid_parts(d, x, y, F.col("sw"), F.col("sh"), grid), keys), "sections")
    own = fills.withColumnRenamed("image_id", "fill_id")
    parts = _grid_parts(own, F.col("x"), F.col("y"), F.col("width"), F.col("height"), grid)
    found = written(nearest(sections, _cell_tones(parts, ["fill_id"]), grid), "found")
    # Many sections may share one feature, such as plain sky: at most one in HOT sections is such a feature.
    hot = F.broadcast(found.filter(F.col("n") > HOT).drop("n"))
    rest = sections.join(hot.select("f"), "f", "left_anti").join(found.filter(F.col("n") <= HOT).drop("n"), "f", "left")
    return rest.unionByName(sections.join(hot, "f")).drop("f")


def mosaic(df: DataFrame, fills: DataFrame, cols=10, rows=10, grid=2) -> DataFrame:
    """Sections replaced by their fill, resized to the section and multiplied per band by
    the ratio of mean tones."""
    chosen = written(section_fills(df, fills, cols, rows, grid), "chosen")  # read three times below
    wanted = chosen.select(F.col("fill_id").alias("image_id"), "sw", "sh").distinct()
    pix = fills.select(*core.COLUMNS)
    # Partial sums first; a fill used at several sizes is scaled once per size.
    sizes = pix.filter((F.col("x") == 0) & (F.col("y") == 0)).select("image_id", "width", "height")
    thumbs = G.scale_area(core.join_per_image(pix, wanted.join(sizes, "image_id")), F.col("sw"), F.col("sh"))
    tones = pix.groupBy("image_id").agg(F.count("*").alias("fn"), *[F.sum(c).alias("f" + c) for c in RGB])
    thumbs = (
        thumbs.join(tones, "image_id")
        .withColumn("salt", F.explode_outer(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        .select(F.col("image_id").alias("fill_id"), F.col("width").alias("sw"), F.col("height").alias("sh"),
                F.col("x").alias("dx"), F.col("y").alias("dy"), "salt", *RGB, "fn", "fr", "fg", "fb")
    )
    means = _sectioned(df, cols, rows).groupBy("image_id", "col", "row").agg(
        F.count("*").alias("sn"), *[F.sum(c).alias("s" + c) for c in RGB])
    spots = (
        chosen.join(means, ["image_id", "col", "row"])
        .withColumn("salt", F.pmod(F.xxhash64("image_id", "col", "row"), F.lit(SALTS)).cast("int"))
        .withColumn("dx", F.explode_outer(F.sequence(F.lit(0), F.col("sw") - 1)))
        .withColumn("dy", F.explode_outer(F.sequence(F.lit(0), F.col("sh") - 1)))
    )
    out = spots.join(thumbs, ["fill_id", "sw", "sh", "dx", "dy", "salt"])

    def toned(c):
        section = F.col("s" + c).cast("double") / F.col("sn")
        fill = F.col("f" + c).cast("double") / F.col("fn")
        # stays missing where either lacks the colour
        return F.when(section.isNotNull() & fill.isNotNull(), floor_byte(F.col(c) * (section / F.greatest(fill, F.lit(0.001)))))

    return core.integers(out.withColumns({
        **{c: toned(c) for c in RGB}, "x": F.col("x0") + F.col("dx"), "y": F.col("y0") + F.col("dy"),
        "a": F.lit(None).cast("int")}))


def same_fill(df: DataFrame, fill: DataFrame, cols=10, rows=10) -> DataFrame:
    """One image fills every section."""
    return mosaic(df, fill, cols, rows, grid=1)
