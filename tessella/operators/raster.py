"""Rasters as pixel tables ``(channel, y, x, value)``: statistics, stretches, painting.

A missing pixel is zero. Value histograms (at most 65,536 rows per image) stand in
for the pixels wherever an order statistic or a cumulative share is needed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.boxes import BOX
from ..functions.pixels import DTYPE_MAX, stretch
from ..runtime import many


def disc(radius: int) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(dy, dx) for dy in span for dx in span if dy * dy + dx * dx <= radius * radius]


def square(radius: int) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(dy, dx) for dy in span for dx in span]


def offsets(shape: str, radius: int) -> Column:
    """Array of ``(dy, dx)`` structs of a disc or square."""
    cells = {"disc": disc, "square": square}[shape](radius)
    return F.array(*(F.struct(F.lit(dy).cast("long").alias("dy"), F.lit(dx).cast("long").alias("dx")) for dy, dx in cells))


def spread(df: DataFrame, shape: str, radius: int) -> DataFrame:
    """Every pixel of the shape around every row's ``(y, x)``."""
    rest = [c for c in df.columns if c not in ("y", "x")]
    return df.withColumn("_o", F.explode(offsets(shape, radius))).select(
        *rest, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x")
    )


# ------------------------------------------------------------------------ tiles


def tile_grid(images: DataFrame, tile: int, overlap: int = 0, halo: int | None = None, pad: bool = False) -> DataFrame:
    """Tile ranges ``row0, col0, row1, col1`` of images with ``height`` and ``width``.

    The last tile is cut at the edge, or keeps full size with ``pad``; ``halo``
    widens every tile inside the image.
    """
    step = tile - overlap
    starts = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.col(size).cast("long") - 1, F.lit(step).cast("long")))
    out = images.withColumn("row0", starts("height")).withColumn("col0", starts("width"))
    grow = halo or 0
    row1, col1 = F.col("row0") + tile + grow, F.col("col0") + tile + grow
    if not pad:
        row1, col1 = F.least(row1, F.col("height")), F.least(col1, F.col("width"))
    out = out.withColumns({"row1": row1, "col1": col1})
    if grow:
        out = out.withColumns({c: F.greatest(F.col(c) - grow, F.lit(0)) for c in ("row0", "col0")})
    return many(out)


def with_tile(df: DataFrame, tile: int) -> DataFrame:
    return df.withColumns({"tile_y": F.floor(F.col("y") / tile) * tile, "tile_x": F.floor(F.col("x") / tile) * tile})


def non_empty_tiles(df: DataFrame, tile: int, keys=()) -> DataFrame:
    """Tiles with at least one non-zero pixel."""
    return (
        with_tile(df, tile).groupBy(*keys, "tile_y", "tile_x").agg(F.max("value").alias("peak")).where("peak > 0")
    )


# ------------------------------------------------------------------- statistics


def box_pixels(boxes: DataFrame, keys=()) -> DataFrame:
    """Pixels of each distinct box (half-open, like array slices)."""
    rows = boxes.select(*keys, *BOX).distinct().where("xmin < xmax AND ymin < ymax")
    rows = rows.withColumn("y", F.explode(F.sequence(F.col("ymin"), F.col("ymax") - 1)))
    return rows.withColumn("x", F.explode(F.sequence(F.col("xmin"), F.col("xmax") - 1)))


def summed_tiles(pixels: DataFrame, on, channel: str, value: str, tile: int) -> DataFrame:
    """Per tile and channel, sums of the values and numbers of the pixels above and left of each place, row by row.

    The tables are ``(tile + 1) ** 2`` long, with zeros in their first row and column.
    """
    keys = [*on, channel, "tile_y", "tile_x"]

    def table(pdf):
        first = pdf.iloc[0]
        y, x = (pdf[a].to_numpy() - first[t] + 1 for a, t in (("y", "tile_y"), ("x", "tile_x")))
        sums, seen = np.zeros((tile + 1, tile + 1)), np.zeros((tile + 1, tile + 1), np.int64)
        np.add.at(sums, (y, x), pdf["_v"].to_numpy(float))
        np.add.at(seen, (y, x), 1)
        found = {"sums": sums.cumsum(0).cumsum(1).ravel(), "seen": seen.cumsum(0).cumsum(1).ravel()}
        return pd.DataFrame([{**{k: first[k] for k in keys}, **found}])

    rows = with_tile(pixels, tile).select(*keys, "y", "x", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"))
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "sums array<double>", "seen array<long>"])
    return rows.groupBy(*keys).applyInPandas(table, schema)


def box_tiles(boxes: DataFrame, tile: int, keys=()) -> DataFrame:
    """The tiles that each distinct box (half-open) touches."""
    rows = boxes.select(*keys, *BOX).distinct().where("xmin < xmax AND ymin < ymax")
    starts = lambda lo, hi: F.sequence(
        (F.floor(F.col(lo) / tile) * tile).cast("long"), (F.floor((F.col(hi) - 1) / tile) * tile).cast("long"), F.lit(tile).cast("long")
    )
    rows = rows.withColumn("tile_y", F.explode(starts("ymin", "ymax")))
    return rows.withColumn("tile_x", F.explode(starts("xmin", "xmax")))


def zonal_mean(
    boxes: DataFrame, pixels: DataFrame, on=(), channel: str = "channel", id_col: str = "ID", value: str = "value", tile: int = 64
) -> DataFrame:
    """Mean pixel per box and channel; equal boxes are measured once. Pixels without a row or a value are zero.

    Sums come from summed-area tables of tiles, four look-ups for each tile that a box touches, so what is
    shuffled grows with tiles and boxes, not with the area of the boxes.
    """
    on = list(on)
    parts = box_tiles(boxes, tile, on).join(summed_tiles(pixels, on, channel, value, tile), [*on, "tile_y", "tile_x"])
    at = lambda side, start: F.least(F.greatest(F.col(side) - F.col(start), F.lit(0)), F.lit(tile)).cast("int")
    y0, y1, x0, x1 = at("ymin", "tile_y"), at("ymax", "tile_y"), at("xmin", "tile_x"), at("xmax", "tile_x")

    def inside(table: str) -> Column:
        look = lambda y, x: F.col(table)[y * (tile + 1) + x]
        return look(y1, x1) - look(y0, x1) - look(y1, x0) + look(y0, x0)

    sums = parts.select(*on, *BOX, channel, inside("sums").alias("_s"), inside("seen").alias("_n"))
    sums = sums.groupBy(*on, *BOX, channel).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")).where("_n > 0")
    stats = sums.withColumn("mean", F.col("_s") / ((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))).drop("_s", "_n")
    return boxes.select(*on, *BOX, id_col).join(stats, [*on, *BOX]).select(*on, id_col, channel, "mean")


def label_mean(labels: DataFrame, pixels: DataFrame, on=(), channel: str = "channel") -> DataFrame:
    """Mean and total pixel per mask label and channel."""
    return (
        labels.join(pixels, [*on, "y", "x"])
        .groupBy(*on, "label", channel)
        .agg(F.avg("value").alias("mean"), F.sum("value").alias("total"))
    )


def region_props(labels: DataFrame, on=()) -> DataFrame:
    """Area, centroid and bounding box (inclusive) per label."""
    return labels.groupBy(*on, "label").agg(
        F.count("*").alias("area"), F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"),
        F.min("y").alias("ymin"), F.min("x").alias("xmin"), F.max("y").alias("ymax"), F.max("x").alias("xmax"),
    )


def histogram(df: DataFrame, keys=()) -> DataFrame:
    return df.groupBy(*keys, "value").agg(F.count("*").alias("n"))


def image_stats(df: DataFrame, keys=(), percentiles=(0.02, 99.8)) -> DataFrame:
    """Minimum, maximum, mean and exact interpolated percentiles, from the histogram."""
    h = histogram(df, keys)
    return h.groupBy(*keys).agg(
        F.min("value").alias("lowest"), F.max("value").alias("highest"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        *(F.percentile("value", p / 100, F.col("n")).alias(f"p{i}") for i, p in enumerate(percentiles)),
    )


def cdf(df: DataFrame, keys=()) -> DataFrame:
    """Histogram with the running share of pixels; the window runs over values, not pixels."""
    w = Window.partitionBy(*keys).orderBy("value")
    total = Window.partitionBy(*keys)
    return histogram(df, keys).withColumn(
        "cdf", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(total)
    )


def stretch_by_cdf(df: DataFrame, keys=(), tolerance: float = 0.01, top: int = 255) -> DataFrame:
    """Stretch so that ``tolerance`` of the pixels saturate at either end.

    The look-up table has one row per value.
    """
    c = cdf(df, keys)
    cuts = c.groupBy(*keys).agg(
        F.min(F.when(F.col("cdf") > tolerance, F.col("value"))).alias("_lo"),
        F.min(F.when(F.col("cdf") >= 1 - tolerance, F.col("value"))).alias("_hi"),
    )
    table = (c.join(cuts, list(keys)) if keys else c.withColumns({n: cuts.select(n).scalar() for n in ("_lo", "_hi")}))
    table = table.select(*keys, "value", stretch(F.col("value"), F.col("_lo"), F.col("_hi"), top).alias("stretched"))
    return df.join(table, [*keys, "value"])


def otsu(df: DataFrame, keys=()) -> DataFrame:
    """Value that maximises the between-class variance; ties take the lowest."""
    w = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    h = histogram(df, keys).withColumn("s", F.col("value") * F.col("n"))
    run = h.select(
        *keys, "value", F.sum("n").over(w).alias("n0"), F.sum("s").over(w).alias("s0"),
        F.sum("n").over(whole).alias("n"), F.sum("s").over(whole).alias("s"),
    )
    n1 = F.col("n") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / n1
    var = F.col("n0").cast("double") * n1 * gap * gap
    best = run.where(n1 > 0).groupBy(*keys).agg(F.max(F.struct(F.round(var, 4).alias("v"), (-F.col("value")).alias("nv"))).alias("b"))
    return best.select(*keys, (-F.col("b.nv")).alias("threshold"))


def median_otsu(df: DataFrame, crop_keys, keys=()) -> DataFrame:
    """Median of the per-crop thresholds."""
    return otsu(df, [*keys, *crop_keys]).groupBy(*keys).agg(F.median("threshold").alias("threshold"))


def binary_difference(target: DataFrame, source: DataFrame, target_cut, source_cut, on=()) -> DataFrame:
    """Per pixel: target foreground and whether the two binary images differ."""
    t = target.select(*on, "y", "x", (F.col("value") >= target_cut).cast("int").alias("_t"), F.lit(0).alias("_s"))
    s = source.select(*on, "y", "x", F.lit(0).alias("_t"), (F.col("value") >= source_cut).cast("int").alias("_s"))
    both = t.unionByName(s).groupBy(*on, "y", "x").agg(F.max("_t").alias("foreground"), F.max("_s").alias("_s"))
    return both.withColumn("differs", (F.col("foreground") != F.col("_s")).cast("int")).drop("_s")


def tile_error(diff: DataFrame, tile: int, on=()) -> DataFrame:
    """Differing pixels over target foreground in percent, per tile; null without foreground."""
    sums = with_tile(diff, tile).groupBy(*on, "tile_y", "tile_x").agg(
        F.sum("differs").alias("diff_area"), F.sum("foreground").alias("foreground")
    )
    return sums.withColumn("error", F.when(F.col("foreground") > 0, F.col("diff_area") / F.col("foreground") * 100))


def global_error(diff: DataFrame) -> DataFrame:
    return diff.agg((F.sum("differs") / F.sum("foreground") * 100).alias("error"))


def line_fit(labels: DataFrame, on=()) -> DataFrame:
    """Least-squares line ``y = slope * x + intercept`` through the pixels of each label."""
    return labels.groupBy(*on, "label").agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")
    )


# --------------------------------------------------------------------- painting


def paint_discs(points: DataFrame, radius: int, keys=("class",), height: int | None = None, width: int | None = None) -> DataFrame:
    """Disc of the radius around every point, as ``(keys, y, x, n)``.

    Points on one pixel are counted before they are spread out.
    """
    spots = points.groupBy(*keys, "y", "x").agg(F.count("*").alias("n"))
    out = spread(spots, "disc", radius).groupBy(*keys, "y", "x").agg(F.sum("n").alias("n"))
    return inside(out, height, width)


def marker_images(cells: DataFrame, markers, radius: int, height: int | None = None, width: int | None = None) -> DataFrame:
    """Centre images per positive marker plus ``all`` and ``uncategorized``."""
    flags = {m: F.col(m) == 1 for m in markers}
    none = ~F.greatest(*(F.col(m) for m in markers)).eqNullSafe(F.lit(1))
    names = F.array(F.lit("all"), *(F.when(f, F.lit(m)) for m, f in flags.items()), F.when(none, F.lit("uncategorized")))
    tagged = cells.select(
        F.explode(F.filter(names, lambda n: n.isNotNull())).alias("class"), F.col("centroid_y").alias("y"), F.col("centroid_x").alias("x")
    )
    return paint_discs(tagged, radius, ["class"], height, width)


def paint_outlines(boxes: DataFrame, keys=()) -> DataFrame:
    """Pixels of the box outlines, without repeats."""
    seq = lambda a, b: F.explode(F.sequence(a, b))
    b = boxes.select(*keys, *BOX).distinct()
    rows = b.select(*keys, seq("xmin", "xmax").alias("x"), F.array("ymin", "ymax").alias("_y")).select(*keys, F.explode("_y").alias("y"), "x")
    cols = b.select(*keys, seq("ymin", "ymax").alias("y"), F.array("xmin", "xmax").alias("_x")).select(*keys, "y", F.explode("_x").alias("x"))
    return rows.unionByName(cols).distinct()


def seed_raster(points: DataFrame, radius: int, shape: str = "square", on=(), id_col: str = "ID", height=None, width=None) -> DataFrame:
    """Each point's id painted over its surroundings; the largest id wins a pixel."""
    spots = points.groupBy(*on, "y", "x").agg(F.max(id_col).alias("label"))
    out = spread(spots, shape, radius).groupBy(*on, "y", "x").agg(F.max("label").alias("label"))
    return inside(out, height, width)


def inside(df: DataFrame, height: int | None, width: int | None) -> DataFrame:
    df = df.where("y >= 0 AND x >= 0") if height is not None or width is not None else df
    if height is not None:
        df = df.where(F.col("y") < height)
    if width is not None:
        df = df.where(F.col("x") < width)
    return df


def conform(df: DataFrame, height: int, width: int, y0: int = 0, x0: int = 0) -> DataFrame:
    """Crop to a window starting at ``(y0, x0)``; area beyond the data is implicit zeros."""
    moved = df.withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})
    return moved.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))


def raster_sum(a: DataFrame, b: DataFrame, keys=()) -> DataFrame:
    """Sum of two channels divided by its maximum."""
    cols = [*keys, "y", "x", "value"]
    total = a.select(*cols).unionByName(b.select(*cols)).groupBy(*keys, "y", "x").agg(F.sum("value").alias("value"))
    return total.withColumn("value", F.col("value") / total.agg(F.max("value").alias("m")).scalar())


def to_dtype(value: Column, dtype: str) -> Column:
    top = DTYPE_MAX[dtype]
    return F.greatest(F.least(F.rint(value), F.lit(float(top))), F.lit(0.0)).cast("long")
