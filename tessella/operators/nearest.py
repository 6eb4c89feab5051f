"""Point joins: within a radius, nearest neighbour, points in tiles.

Points that share a location are merged before the join and expanded after it,
so a pile of copies costs one point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import many, stage

#: Ratio of cell sizes between two levels.
STEP = 4


def _cell(v: Column, size) -> Column:
    return F.floor(v / size)


def _around(df: DataFrame, x: str, y: str, size) -> DataFrame:
    """Nine rows per point, one for each cell of its 3 x 3 neighbourhood."""
    three = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    return df.withColumn("_cx", F.explode(F.transform(three, lambda i: _cell(F.col(x), size) + i))).withColumn(
        "_cy", F.explode(F.transform(three, lambda i: _cell(F.col(y), size) + i))
    )


def _sq(ax, ay, bx, by) -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return dx * dx + dy * dy


def within_radius(left: DataFrame, right: DataFrame, radius: float, on=()) -> DataFrame:
    """Pairs ``(ax, ay, bx, by, sq_dist)`` of locations at most ``radius`` apart.

    ``left`` has columns ``ax, ay``; ``right`` has ``bx, by``; others are kept.
    """
    on = list(on)
    a = left.withColumns({"_cx": _cell(F.col("ax"), radius), "_cy": _cell(F.col("ay"), radius)})
    b = _around(right, "bx", "by", radius)
    return (
        a.join(many(b), [*on, "_cx", "_cy"])
        .withColumn("sq_dist", _sq("ax", "ay", "bx", "by"))
        .where(F.col("sq_dist") <= radius * radius)
        .drop("_cx", "_cy")
    )


def radius_self(points: DataFrame, radius: float, on=(), x: str = "centroid_x", y: str = "centroid_y", id_col: str = "ID") -> DataFrame:
    """Neighbouring *locations* within the radius, each pair once.

    ``n_a`` and ``n_b`` say how many points lie at each location and ``id_a``,
    ``id_b`` name the first of them; a location holding several points also
    appears as a pair with itself. The pairs of single points follow by joining
    back on the location, without listing every pair of copies.
    """
    on = list(on)
    sites = points.groupBy(*on, x, y).agg(F.min(id_col).alias("id"), F.count("*").alias("n"))
    side = lambda s: sites.select(
        *on, F.col(x).alias(f"{s}x"), F.col(y).alias(f"{s}y"), F.col("id").alias(f"id_{s}"), F.col("n").alias(f"n_{s}")
    )
    pairs = within_radius(side("a"), side("b"), radius, on)
    before = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    shared = (F.col("id_a") == F.col("id_b")) & (F.col("n_a") > 1)
    return pairs.where(before | shared)


def _cell_pairs(spots: DataFrame, sites: DataFrame, on, cell: float, top: int, limit: float | None) -> DataFrame:
    """Pairs ``(on, px, py, qx, qy)`` of finest cells of which the second may hold the nearest site of the first.

    Both grids are refined together, from one cell to sixteen. Of the pairs below a kept pair those stay whose
    least distance is not above the smallest greatest distance that the spot's cell has with any cell of sites.

    Staged cells take few bytes in their files and many in memory, so they are not broadcast by the size of the files.
    """
    at = lambda c, size: F.floor(F.col(c) / size)
    pairs = None
    for level in range(top, -1, -1):
        size = cell * STEP**level
        p = spots.select(*on, at("ax", size).alias("px"), at("ay", size).alias("py")).distinct()
        q = sites.select(*on, at("bx", size).alias("qx"), at("by", size).alias("qy")).distinct()
        up = lambda df, x, y: df.withColumns({f"_{x}": F.floor(F.col(x) / STEP), f"_{y}": F.floor(F.col(y) / STEP)})
        # pairs meet the cells of points last, so that the cells below one cell lie together when they are compared
        if pairs is None:  # the coarsest cells are as wide as the data: no more than a few for each key
            place = [*on, "_all"]
            both = many(p.withColumn("_all", F.lit(0))).join(q.withColumn("_all", F.lit(0)), place)
        else:
            place = [*on, "_px", "_py"]
            old = pairs.select(*on, *(F.col(c).alias(f"_{c}") for c in ("px", "py", "qx", "qy")))
            both = many(many(old).join(up(q, "qx", "qy"), [*on, "_qx", "_qy"])).join(up(p, "px", "py"), place)
        gap = lambda a, b, k: F.greatest(F.lit(0), F.abs(F.col(a) - F.col(b)) + k) * size
        low, high = (gap("px", "qx", k) ** 2 + gap("py", "qy", k) ** 2 for k in (-1, 1))
        least = F.min("high").over(Window.partitionBy(*place, "px", "py"))
        near = both.withColumns({"low": low, "high": high}).withColumn("_least", least).where("low <= _least")
        near = near if limit is None else near.where(F.col("low") <= limit * limit)
        pairs = stage(near.select(*on, "px", "py", "qx", "qy"), "cells")
    return pairs


def nearest(
    points: DataFrame,
    targets: DataFrame,
    id_col: str,
    target_id: str,
    on=(),
    start: float = 8.0,
    max_distance: float | None = None,
) -> DataFrame:
    """Nearest target of every point; ties take the lowest id.

    ``points`` has ``id_col, x, y`` and ``targets`` has ``target_id, x, y``. Cells of points are
    paired with the cells of targets that distance bounds leave, from the extent of the data down to cells
    of ``start``, and only their members are compared: far crowds meet in the cells that face each other.

    Returns ``on, id_col, target_id, distance``; points with no target at all (or
    none within ``max_distance``) are left out.
    """
    on = list(on)
    sites = targets.groupBy(*on, F.col("x").alias("bx"), F.col("y").alias("by")).agg(F.min(target_id).alias(target_id))
    sites = stage(sites, "targets")
    spots = stage(points.select(*on, F.col("x").alias("ax"), F.col("y").alias("ay")).distinct(), "spots")
    ends = sites.select(F.col("bx").alias("x"), F.col("by").alias("y")).unionByName(
        spots.select(F.col("ax").alias("x"), F.col("ay").alias("y"))
    ).agg(*(F.max(F.abs(c)).alias(c) for c in "xy")).first()
    extent = max([float(v) for v in ends if v is not None], default=0.0)
    top = 0
    while start * STEP**top <= extent:
        top += 1
    pairs = _cell_pairs(spots, sites, on, start, top, max_distance)
    inside = lambda df, x, y, cx, cy: df.withColumns({cx: F.floor(F.col(x) / start), cy: F.floor(F.col(y) / start)})
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    met = many(many(pairs).join(inside(sites, "bx", "by", "qx", "qy"), [*on, "qx", "qy"])).join(inside(spots, "ax", "ay", "px", "py"), [*on, "px", "py"])
    met = met.withColumn("sq_dist", (dx * dx + dy * dy).cast("double"))
    if max_distance is not None:
        met = met.where(F.col("sq_dist") <= max_distance * max_distance)
    # px and py follow from the point; with them its pairs are already together
    best = met.groupBy(*on, "px", "py", F.col("ax").alias("x"), F.col("ay").alias("y")).agg(F.min(F.struct("sq_dist", target_id)).alias("_m"))
    best = best.select(*on, "x", "y", "_m.*")
    return many(points).join(best, [*on, "x", "y"]).select(*on, id_col, target_id, F.sqrt("sq_dist").alias("distance"))


def nearest_within(points: DataFrame, targets: DataFrame, id_col: str, target_id: str, limit: float, on=()) -> DataFrame:
    """Nearest targets closer than ``limit``; all tied targets are returned.

    One grid join with cells of the limit; the least distance per location comes
    from an aggregate, then ties are read back.
    """
    on = list(on)
    spots = points.select(*on, F.col("x").alias("ax"), F.col("y").alias("ay")).distinct()
    sites = targets.select(*on, F.col("x").alias("bx"), F.col("y").alias("by")).distinct()
    pairs = within_radius(spots, sites, limit, on).where(F.col("sq_dist") < limit * limit)
    least = pairs.groupBy(*on, "ax", "ay").agg(F.min("sq_dist").alias("_least"))
    ties = pairs.join(least, [*on, "ax", "ay"]).where("sq_dist = _least").drop("_least")
    t = targets.select(*on, F.col("x").alias("bx"), F.col("y").alias("by"), target_id)
    p = points.select(*on, F.col("x").alias("ax"), F.col("y").alias("ay"), id_col)
    return (
        p.join(ties, [*on, "ax", "ay"])
        .join(t, [*on, "bx", "by"])
        .select(*on, id_col, target_id, F.sqrt("sq_dist").alias("distance"))
    )


def tile_of(lo: Column, tile: int, step: int) -> tuple[Column, Column]:
    """First and last tile number whose closed range [k*step, k*step + tile] holds ``lo``."""
    return F.greatest(F.ceil((lo - tile) / step), F.lit(0)), F.floor(lo / step)


def points_in_tiles(points: DataFrame, height: int, width: int, tile: int, overlap: int = 0, halo: int = 0, x: str = "x", y: str = "y") -> DataFrame:
    """Points with every tile they belong to (``tile_y``, ``tile_x`` corners), bounds inclusive.

    Tile numbers follow from arithmetic, so there is no join. ``halo`` widens
    tiles on all sides, as for source key points.
    """
    step = tile - overlap

    def tiles(v, size):
        last = (size - 1) // step
        lo = F.greatest(F.ceil((v - tile - halo) / step), F.lit(0))
        hi = F.least(F.floor((v + halo) / step), F.lit(last))
        return F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda k: k * step), (lo <= hi) & (v >= 0) & (v <= size)

    ty, ok_y = tiles(F.col(y), height)
    tx, ok_x = tiles(F.col(x), width)
    out = points.where(ok_y & ok_x).withColumn("tile_y", F.explode(ty)).withColumn("tile_x", F.explode(tx))
    # the last tile is cut at the image edge
    return out.where(
        (F.col(y) <= F.least(F.col("tile_y") + tile, F.lit(height)) + halo)
        & (F.col(x) <= F.least(F.col("tile_x") + tile, F.lit(width)) + halo)
    )


def boxes_in_tiles(boxes: DataFrame, tile: int, step: int | None = None, height: int | None = None, width: int | None = None) -> DataFrame:
    """Boxes with every tile that contains them fully (half-open), as tile corners."""
    step = step or tile

    def tiles(lo, hi, size):
        first = F.greatest(F.floor((hi - tile) / step) + 1, F.lit(0))
        last = F.floor(lo / step)
        if size is not None:
            last = F.least(last, F.lit((size - 1) // step))
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda k: k * step)).otherwise(F.array().cast("array<bigint>"))

    return boxes.withColumn("tile_y", F.explode(tiles(F.col("ymin"), F.col("ymax"), height))).withColumn(
        "tile_x", F.explode(tiles(F.col("xmin"), F.col("xmax"), width))
    )
