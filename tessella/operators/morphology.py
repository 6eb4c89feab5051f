"""Label masks and binary morphology on sparse pixel tables."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.boxes import BOX
from .graph import components
from .masks import SIDE
from .raster import region_props

SHIFT = 2**32  # pixel id = y * 2^32 + x, in row-major order


def runs(mask: DataFrame, on=()) -> DataFrame:
    """Horizontal runs ``(on, y, x0, x1)``, ends included, of a mask's distinct pixels."""
    row = [*on, "y"]
    island = F.col("x") - F.row_number().over(Window.partitionBy(*row).orderBy("x"))
    pixels = mask.select(*on, "y", "x").distinct().withColumn("_island", island)
    return pixels.groupBy(*row, "_island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_island")


def _pixels(found: DataFrame, on) -> DataFrame:
    return found.select(*on, "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def _rows_of(shape: str, radius: int) -> Column:
    """For each row of a shape its distance ``dy`` and half width ``w``."""
    width = {"disc": lambda dy: isqrt(radius * radius - dy * dy), "square": lambda dy: radius}[shape]
    return F.array(*(F.struct(F.lit(dy).cast("long").alias("dy"), F.lit(width(dy)).cast("long").alias("w")) for dy in range(-radius, radius + 1)))


def _dilated(found: DataFrame, radius: int, shape: str, on) -> DataFrame:
    """Runs of a dilated mask: each run is widened once for every row of the shape, then overlapping ones merge."""
    row = [*on, "y"]
    wide = found.withColumn("_o", F.explode(_rows_of(shape, radius)))
    wide = wide.select(*on, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x0") - F.col("_o.w")).alias("x0"), (F.col("x1") + F.col("_o.w")).alias("x1"))
    # of runs that start at one place only the longest counts
    wide = wide.groupBy(*row, "x0").agg(F.max("x1").alias("x1"))
    ordered = Window.partitionBy(*row).orderBy("x0")
    before = F.max("x1").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = wide.withColumn("_new", F.coalesce((F.col("x0") > before + 1).cast("int"), F.lit(1)))
    marked = marked.withColumn("_run", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*row, "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def _eroded(found: DataFrame, radius: int, shape: str, on) -> DataFrame:
    """Runs of an eroded mask: places that a narrowed run covers for every row of the shape."""
    row = [*on, "y"]
    small = found.withColumn("_o", F.explode(_rows_of(shape, radius)))
    small = small.select(*on, (F.col("y") - F.col("_o.dy")).alias("y"), (F.col("x0") + F.col("_o.w")).alias("x0"), (F.col("x1") - F.col("_o.w")).alias("x1"))
    steps = small.where("x0 <= x1").select(
        *row, F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("n")), F.struct((F.col("x1") + 1).alias("x"), F.lit(-1).alias("n")))).alias("_s")
    )
    steps = steps.groupBy(*row, F.col("_s.x").alias("x0")).agg(F.sum("_s.n").alias("n")).where("n <> 0")
    ordered = Window.partitionBy(*row).orderBy("x0")
    cover = F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return steps.select(*row, "x0", (F.lead("x0").over(ordered) - 1).alias("x1"), cover.alias("n")).where(F.col("n") == 2 * radius + 1).drop("n")


def dilate(mask: DataFrame, radius: int, shape: str = "disc", on=()) -> DataFrame:
    """Pixels with a set pixel in their neighbourhood.

    Works on horizontal runs, so a run is repeated once for each row of the shape and no pixel is multiplied by its area.
    """
    return _pixels(_dilated(runs(mask, on), radius, shape, on), on)


def erode(mask: DataFrame, radius: int, shape: str = "disc", on=()) -> DataFrame:
    """Pixels whose whole neighbourhood is set; what lies outside the mask is not."""
    return _pixels(_eroded(runs(mask, on), radius, shape, on), on)


def close(mask: DataFrame, radius: int, shape: str = "disc", on=()) -> DataFrame:
    return _pixels(_eroded(_dilated(runs(mask, on), radius, shape, on), radius, shape, on), on)


def smooth(mask: DataFrame, size: int = 11, share: float = 0.5, on=()) -> DataFrame:
    """Mean filter of odd ``size``, then keep pixels above ``share``; rows first, then columns."""
    half = size // 2
    line = F.sequence(F.lit(-half), F.lit(half))
    rows = (
        mask.select(*on, "y", "x").distinct()
        .withColumn("x", F.explode(F.transform(line, lambda d: F.col("x") + d)))
        .groupBy(*on, "y", "x").agg(F.count("*").alias("n"))
    )
    both = rows.withColumn("y", F.explode(F.transform(line, lambda d: F.col("y") + d))).groupBy(*on, "y", "x").agg(F.sum("n").alias("n"))
    return both.where(F.col("n") > share * size * size).select(*on, "y", "x")


def _spread(bits: Column, radius: int) -> Column:
    """A block of 8 x 8 pixels dilated by a disc of up to 8: ``(dy, dx, bits)`` for the block itself and its eight neighbours."""
    disc = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-isqrt(radius * radius - dy * dy), isqrt(radius * radius - dy * dy) + 1)]

    def moved(by, bx):
        found = F.lit(0).cast("long")
        for dy, dx in disc:
            inside = [y * SIDE + x for y in range(SIDE) for x in range(SIDE) if 0 <= y + dy - by * SIDE < SIDE and 0 <= x + dx - bx * SIDE < SIDE]
            if inside:
                mask, by_bits = sum(1 << i for i in inside), (dy - by * SIDE) * SIDE + dx - bx * SIDE
                some = bits.bitwiseAND(F.lit(mask - (mask >> 63 << 64)).cast("long"))
                found = found.bitwiseOR(F.call_function("shiftleft" if by_bits >= 0 else "shiftrightunsigned", some, F.lit(abs(by_bits))))
        return found

    return F.array(*(F.struct(F.lit(by).alias("dy"), F.lit(bx).alias("dx"), moved(by, bx).alias("bits")) for by in (-1, 0, 1) for bx in (-1, 0, 1)))


def _grown(found: DataFrame, cell: str, source: str, radius: int, name: str) -> DataFrame:
    """Blocks ``(cell, _by, _bx, ...)`` with the dilated bits of ``source`` as ``name``; the other columns stay where they are."""
    place, kept = [cell, "_by", "_bx"], [c for c in found.columns if c not in (cell, "_by", "_bx")]
    bits, here = F.col("_s.bits"), (F.col("_s.dy") == 0) & (F.col("_s.dx") == 0)
    # pixels of no x are not dilated, and those of no y only along x: they are held in the first row
    bits = F.when(F.col("_bx").isNull(), 0).when(F.col("_by").isNotNull(), bits).when(F.col("_s.dy") == 0, bits.bitwiseAND(F.lit(255).cast("long"))).otherwise(0)
    rows = found.withColumn("_s", F.explode(_spread(F.col(source), radius))).select(
        cell, (F.col("_by") + F.col("_s.dy")).alias("_by"), (F.col("_bx") + F.col("_s.dx")).alias("_bx"),
        *(F.when(here, F.col(c)).otherwise(0).alias(c) for c in kept), bits.alias(name), here.alias("_here"),
    )
    # places of no bit at all would only be carried along
    rows = rows.where(F.col("_here") | (F.col(name) != 0))
    return rows.groupBy(*place).agg(*(F.bit_or(c).alias(c) for c in (*kept, name)))


def compartments(nucleus: DataFrame, cell: str = "cell", processes: DataFrame | None = None) -> DataFrame:
    """Soma, membrane, whole cell and cytoplasm of each cell as ``(cell, part, y, x)``.

    soma = dilated nucleus (2) without the nucleus; body = dilated nucleus and
    processes; membrane = dilated body (1) without the body; whole = body and
    membrane; cytoplasm = whole without nucleus and membrane.

    Masks are held as blocks of 8 x 8 pixels, which are dilated by shifts of their bits; pixels are listed at the end only.
    """
    keys, place = [cell, "y", "x"], [cell, "_by", "_bx"]
    bit = F.coalesce(F.pmod("y", F.lit(SIDE)), F.lit(0)) * SIDE + F.coalesce(F.pmod("x", F.lit(SIDE)), F.lit(0))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))
    named = lambda df, *own: df.select(*keys, *(F.lit(int(n in own)).alias(f"_{n}") for n in ("n", "p")))
    pixels = named(nucleus, "n") if processes is None else named(nucleus, "n").unionByName(named(processes, "p"))
    # pixels are dealt by cell once; all that follows is grouped within cells, so nothing larger is shuffled
    pixels = pixels.repartition(cell).withColumns({"_by": F.floor(F.col("y") / SIDE), "_bx": F.floor(F.col("x") / SIDE)})
    found = pixels.groupBy(*place).agg(*(F.bit_or(one * F.col(f"_{n}")).alias(n) for n in ("n", "p")))
    found = _grown(found, cell, "n", 2, "g").withColumn("b", F.col("g").bitwiseOR(F.col("p"))).drop("p")
    found = _grown(found, cell, "b", 1, "w")
    at = lambda c: F.call_function("shiftrightunsigned", c, F.col("_i")).bitwiseAND(F.lit(1).cast("long")) == 1
    every = F.col("n").bitwiseOR(F.col("b")).bitwiseOR(F.col("w"))
    seen = found.withColumn("_i", F.explode(F.array(*(F.lit(i) for i in range(SIDE * SIDE))))).where(at(every))
    n, g, b = (at(F.col(c)) for c in "ngb")
    parts = F.array(
        F.when(g & ~n, F.lit("soma")), F.when(~b, F.lit("membrane")), F.lit("whole_cell"), F.when(b & ~n, F.lit("cytoplasm"))
    )
    y, x = F.col("_by") * SIDE + F.floor(F.col("_i") / SIDE), F.col("_bx") * SIDE + F.col("_i") % SIDE
    return seen.select(cell, F.explode(parts).alias("part"), y.alias("y"), x.alias("x")).where("part IS NOT NULL")


def _label_block(diagonal: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], ignore_index=True)
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        r, c = y - y.min(), x - x.min()
        grid = np.full((r.max() + 2, c.max() + 3), -1)
        grid[r, c + 1] = np.arange(len(pdf))
        steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
        u, v = [], []
        for dy, dx in steps:
            other = grid[r + dy, c + 1 + dx]
            hit = other >= 0
            u.append(np.nonzero(hit)[0])
            v.append(other[hit])
        u, v = np.concatenate(u), np.concatenate(v)
        root = np.arange(len(pdf))
        while True:
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, root[u], low)
            np.minimum.at(new, root[v], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        pdf["label"] = y[root] * SHIFT + x[root]
        return pdf

    return run


def label(mask: DataFrame, on=(), diagonal: bool = True, block: int = 128) -> DataFrame:
    """Label touching pixels; a label is the id of its first pixel in row-major order.

    Blocks of fixed size are labelled in numpy (a group never holds more than
    ``block`` squared pixels). Labels that touch across block edges form a small
    graph whose components give the final names, so the rounds depend on blocks,
    not on pixels.
    """
    on = list(on)
    px = mask.select(*on, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    px = px.withColumns({"_by": F.floor(F.col("y") / block), "_bx": F.floor(F.col("x") / block)})
    from ..runtime import stage

    schema = px.schema.simpleString()[len("struct<"):-1].replace(":", " ") + ", label long"
    local = stage(px.groupBy(*on, "_by", "_bx").applyInPandas(_label_block(diagonal), schema), "blocks")
    edge = local.where(
        (F.col("y") % block).isin(0, block - 1) | (F.col("x") % block).isin(0, block - 1)
    )
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    shift = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps))
    out = edge.withColumn("_o", F.explode(shift)).select(
        *on, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"), F.col("label").alias("u")
    )
    pairs = out.join(edge.select(*on, "y", "x", F.col("label").alias("v")), [*on, "y", "x"]).where("u <> v")
    names = components(pairs.select(*on, "u", "v").distinct(), on)
    names = names.select(*on, F.col("node").alias("label"), F.col("label").alias("_name"))
    return local.join(names, [*on, "label"], "left").select(*on, "y", "x", F.coalesce("_name", "label").alias("label"))


def area_filter(labels: DataFrame, low: int = 0, high: int | None = None, on=()) -> DataFrame:
    """Keep labels whose pixel count lies in [low, high]."""
    n = labels.groupBy(*on, "label").agg(F.count("*").alias("n")).where(F.col("n") >= low)
    n = n if high is None else n.where(F.col("n") <= high)
    return labels.join(n, [*on, "label"], "left_semi")


def fill_boxes(labels: DataFrame, on=()) -> DataFrame:
    """Replace every label by its filled bounding box; overlaps keep the largest label."""
    p = region_props(labels, on)
    rows = p.select(*on, "label", F.explode(F.sequence("ymin", "ymax")).alias("y"), "xmin", "xmax")
    full = rows.select(*on, "label", "y", F.explode(F.sequence("xmin", "xmax")).alias("x"))
    return full.groupBy(*on, "y", "x").agg(F.max("label").alias("label"))


def clear_border(labels: DataFrame, height: int, width: int, edge: int = 1, on=()) -> DataFrame:
    """Drop labels within ``edge`` pixels of the tile border.

    If that would drop every label of a tile, its largest one stays.
    """
    on = list(on)
    at_edge = (F.col("y") < edge) | (F.col("x") < edge) | (F.col("y") >= height - edge) | (F.col("x") >= width - edge)
    info = labels.groupBy(*on, "label").agg(F.max(at_edge.cast("int")).alias("cut"), F.count("*").alias("area"))
    per = info.groupBy(*on).agg(
        F.min("cut").alias("_all"), F.max(F.struct("area", (-F.col("label")).alias("neg"))).alias("_big")
    )
    joined = info.join(per, on) if on else info.withColumns({c: per.select(c).scalar() for c in ("_all", "_big")})
    keep = joined.where((F.col("cut") == 0) | ((F.col("_all") == 1) & (F.col("label") == -F.col("_big.neg"))))
    return labels.join(keep.select(*on, "label"), [*on, "label"], "left_semi")


def pick_center(labels: DataFrame, center_y: float, center_x: float, on=("crop",)) -> DataFrame:
    """Per crop the component nearest the centre; ties take the larger, then the lower label."""
    on = list(on)
    p = region_props(labels, on)
    dy, dx = F.col("centroid_y") - center_y, F.col("centroid_x") - center_x
    best = p.groupBy(*on).agg(F.min(F.struct((dy * dy + dx * dx).alias("d"), (-F.col("area")).alias("a"), F.col("label"))).alias("b"))
    return labels.join(best.select(*on, F.col("b.label").alias("label")), [*on, "label"], "left_semi")


def meeting_both(labels: DataFrame, first: DataFrame, second: DataFrame, on=()) -> DataFrame:
    """Components that contain a pixel of both point sets."""
    place = [*on, "y", "x"]
    hit = lambda pts: labels.join(pts.select(*place), place, "left_semi").select(*on, "label").distinct()
    return labels.join(hit(first), [*on, "label"], "left_semi").join(hit(second), [*on, "label"], "left_semi")


def grow_from_seeds(states: DataFrame, on=()) -> DataFrame:
    """Pixels reached from seeds (state 1) through open pixels (state 0), 4-neighbour, blocked by -1.

    Equals the components of the non-negative pixels that hold a seed.
    """
    place = [*on, "y", "x"]
    labels = label(states.where("state >= 0").select(*place), on, diagonal=False)
    seeds = labels.join(states.where("state = 1").select(*place), place, "left_semi").select(*on, "label").distinct()
    return labels.join(seeds, [*on, "label"], "left_semi").select(*place)


def _sliding(a: np.ndarray, half: int, pick, fill) -> np.ndarray:
    """Row-wise sliding extreme over ``2 * half + 1`` cells, by doubling."""
    width = 2 * half + 1
    out = np.pad(a, ((0, 0), (half, half)), constant_values=fill)
    done = 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[:, : out.shape[1] - step], out[:, step:])
        done += step
    return out


def _extreme(a: np.ndarray, radius: int, pick, fill) -> np.ndarray:
    """Minimum or maximum over a disc; cells beyond the array do not count."""
    out = np.full(a.shape, fill, a.dtype)
    for dy in range(-radius, radius + 1):
        row = _sliding(a, int((radius * radius - dy * dy) ** 0.5), pick, fill)
        lo, hi = max(0, -dy), min(a.shape[0], a.shape[0] - dy)
        out[lo:hi] = pick(out[lo:hi], row[lo + dy : hi + dy])
    return out


def opened(a: np.ndarray, radius: int) -> np.ndarray:
    """Grey opening with a disc."""
    info = np.iinfo(a.dtype)
    low = _extreme(a, radius, np.minimum, info.max)
    return _extreme(low, radius, np.maximum, info.min)


def subtract_background(pixels: DataFrame, height: int, width: int, diameters=(40, 80), block: int = 512, on=("channel",)) -> DataFrame:
    """Subtract the background found by successive openings with discs.

    Blocks carry a halo of twice the sum of the radii, so the result does not
    depend on the block size; a group never exceeds the block plus its halo.
    Follow with ``functions.pixels.rescale`` for the global stretch.
    """
    on = list(on)
    radii = [d // 2 for d in diameters]
    halo = 2 * sum(radii)

    def numbers(v, size):
        last = (size - 1) // block
        lo = F.greatest(F.floor((v - halo) / block), F.lit(0))
        hi = F.least(F.floor((v + halo) / block), F.lit(last))
        return F.explode(F.sequence(lo, hi))

    spread_px = pixels.select(*on, "y", "x", "value").withColumn("_by", numbers(F.col("y"), height)).withColumn(
        "_bx", numbers(F.col("x"), width)
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by, bx = int(pdf["_by"].iloc[0]), int(pdf["_bx"].iloc[0])
        y0, x0 = max(0, by * block - halo), max(0, bx * block - halo)
        y1, x1 = min(height, (by + 1) * block + halo), min(width, (bx + 1) * block + halo)
        a = np.zeros((y1 - y0, x1 - x0), np.int64)
        a[pdf["y"] - y0, pdf["x"] - x0] = pdf["value"]
        back = a
        for r in radii:
            back = opened(back, r)
        mine = pdf[(pdf["y"] // block == by) & (pdf["x"] // block == bx)]
        value = np.maximum(mine["value"].to_numpy() - back[mine["y"] - y0, mine["x"] - x0], 0)
        return mine.drop(columns=["_by", "_bx"]).assign(value=value)

    schema = pixels.select(*on, "y", "x", "value").schema
    return spread_px.groupBy(*on, "_by", "_bx").applyInPandas(run, schema)


def merge_tiles(tiles: DataFrame, margin: int = 0, on=()) -> DataFrame:
    """Touching tile windows ``(row0, col0, row1, col1)`` merged into their common window."""
    from .overlap import box_pairs

    on = list(on)
    t = tiles.select(
        *on, F.col("tile_id").alias("id"), F.col("col0").alias("xmin"), F.col("row0").alias("ymin"),
        F.col("col1").alias("xmax"), F.col("row1").alias("ymax"),
    )
    # equal windows touch: the first stands for its copies, each of which hangs on it by one edge
    whole = t.where("xmin <= xmax AND ymin <= ymax")
    for k in on:
        whole = whole.where(F.col(k).isNotNull())
    first = whole.groupBy(*on, *BOX).agg(F.min("id").alias("id"))
    touch = box_pairs(first, first, on, cell=1024.0, touching=True).where("a.id < b.id")
    touch = touch.select(*on, F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    copies = whole.join(first.withColumnRenamed("id", "u"), [*on, *BOX]).select(*on, "u", F.col("id").alias("v")).where("u < v")
    names = components(touch.unionByName(copies), on)
    named = t.join(names.select(*on, F.col("node").alias("id"), "label"), [*on, "id"], "left")
    ends = named.groupBy(*on, F.coalesce("label", "id").alias("window")).agg(
        F.min("ymin").alias("row0"), F.min("xmin").alias("col0"), F.max("ymax").alias("row1"), F.max("xmax").alias("col1"), F.count("*").alias("tiles")
    )
    grown = F.when(F.col("tiles") > 1, F.lit(margin)).otherwise(F.lit(0))
    return ends.withColumns(
        {
            "row0": F.greatest(F.col("row0") - grown, F.lit(0)), "col0": F.greatest(F.col("col0") - grown, F.lit(0)),
            "row1": F.col("row1") + grown, "col1": F.col("col1") + grown,
        }
    )
