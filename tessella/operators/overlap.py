"""Spatial joins of boxes and points on a hierarchical grid.

A box belongs to the finest level whose cell is at least as large as its longer
side, so it touches at most four cells there. Two boxes meet on the coarser of
their two levels: the larger box is stored once at its own level ("home") and the
smaller one is also sent to that level ("visitor"). Visitors never meet visitors,
so a few very large boxes do not pull all small boxes into one cell. A pair is
emitted only by the cell that holds the lower-left corner of its intersection,
which removes duplicates without a distinct.

The join is a sort-merge join on integer keys, since both sides are multiplied by
their cells and none of them belongs into the driver; AQE splits hot cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.boxes import BOX, Box, intersection, ioa, iou, sq_dist
from ..runtime import many

STEP = 4.0  # ratio of cell sizes between levels
_HOME_HOME, _HOME_VISITOR, _VISITOR_HOME = 0, 1, 2


def _level(box: Box, cell: float) -> Column:
    side = F.greatest(box.width(), box.height()).cast("double")
    return F.when(side <= cell, F.lit(0)).otherwise(F.ceil(F.log(STEP, side / cell)).cast("int"))


def _valid(df: DataFrame) -> DataFrame:
    return df.where("xmin <= xmax AND ymin <= ymax")


def _flat(df: DataFrame, on, side: str) -> DataFrame:
    """Keys plus every column under a side prefix; structs are rebuilt after the join."""
    return df.select(*on, *(F.col(c).alias(f"_{side}_{c}") for c in df.columns))


def _side(side: str, columns) -> Column:
    return F.struct(*(F.col(f"_{side}_{c}").alias(c) for c in columns)).alias(side)


def _box(side: str) -> Box:
    return Box(*(F.col(f"_{side}_{c}") for c in BOX))


def _emit(df: DataFrame, on, side: str, cell: float, top: Column | None, span: int | None = None) -> DataFrame:
    """One row per grid cell the box takes part in; ``top`` None means one level.

    A box visits the levels above its own up to ``top``, but no more than ``span`` of them.
    """
    box = _box(side)
    flat = _flat(_valid(df), on, side)
    if top is None:
        size = F.lit(cell)
        level = flat.withColumns({"_level": F.lit(0), "_kind": F.lit(_HOME_HOME)})
    else:
        own, other = (_HOME_VISITOR, _VISITOR_HOME) if side == "a" else (_VISITOR_HOME, _HOME_VISITOR)
        home = F.when(F.col("_own") > 0, F.array(F.lit(_HOME_HOME), F.lit(own))).otherwise(
            F.array(F.lit(_HOME_HOME))
        )
        size = F.pow(F.lit(STEP), F.col("_level")) * cell
        last = F.greatest(F.col("_own"), top)
        last = last if span is None else F.least(last, F.col("_own") + span)
        level = (
            flat.withColumn("_own", _level(box, cell))
            .withColumn("_top", last)
            .withColumn("_level", F.explode(F.sequence("_own", "_top")))
            .withColumn(
                "_kind",
                F.explode(F.when(F.col("_level") == F.col("_own"), home).otherwise(F.array(F.lit(other)))),
            )
            .drop("_own", "_top")
        )

    def cells(lo, hi):
        return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))

    return level.withColumn("_cx", cells(box.xmin, box.xmax)).withColumn("_cy", cells(box.ymin, box.ymax))


def box_pairs(
    left: DataFrame,
    right: DataFrame,
    on=(),
    cell: float = 64.0,
    touching: bool = False,
    max_side: float | None = None,
    top: Column | str | None = "find",
    span: int | None = None,
) -> DataFrame:
    """Pairs of intersecting boxes as struct columns ``a`` and ``b``.

    ``on`` are equality keys such as the image. ``max_side`` bounds the longest
    box side when the caller knows it; otherwise one aggregate finds it. ``top``
    gives the coarsest level directly (None for a single level). ``span`` bounds the levels
    between two boxes of a pair, for rules that wide boxes cannot meet with small ones.
    """
    on = list(on)
    if not isinstance(top, str):
        pass
    elif max_side is None:
        tops = [
            _valid(df).agg(F.max(_level(Box.of(), cell)).alias("top")) for df in (left, right)
        ]
        top = F.coalesce(F.greatest(tops[0].scalar(), tops[1].scalar()), F.lit(0))
    elif max_side <= cell:
        top = None
    else:
        level = 1
        while cell * STEP**level < max_side:
            level += 1
        top = F.lit(level)
    a, b = _emit(left, on, "a", cell, top, span), _emit(right, on, "b", cell, top, span)
    pairs = many(a).join(many(b), [*on, "_level", "_kind", "_cx", "_cy"])
    p, q = _box("a"), _box("b")
    size = F.pow(F.lit(STEP), F.col("_level")) * cell
    x0, y0 = F.greatest(p.xmin, q.xmin), F.greatest(p.ymin, q.ymin)
    dx, dy = F.least(p.xmax, q.xmax) - x0, F.least(p.ymax, q.ymax) - y0
    meets = (dx >= 0) & (dy >= 0) if touching else (dx > 0) & (dy > 0)
    owner = (F.floor(x0 / size) == F.col("_cx")) & (F.floor(y0 / size) == F.col("_cy"))
    return pairs.where(meets & owner).select(*on, _side("a", left.columns), _side("b", right.columns))


def iou_span(threshold: float) -> int | None:
    """Levels between two boxes whose IoU is above ``threshold``: their longer sides differ by less than 1 / threshold."""
    return None if threshold <= 0 else max(1, math.ceil(math.log(1 / threshold, STEP)))


def box_overlap(left: DataFrame, right: DataFrame, on=(), **grid) -> DataFrame:
    """Every intersecting pair with its intersection, IoU and both IoA values."""
    p, q = Box.of("a"), Box.of("b")
    return box_pairs(left, right, on, **grid).withColumns(
        {"intersection": intersection(p, q), "iou": iou(p, q), "ioa": ioa(p, q), "ioa_rev": ioa(q, p)}
    )


def prune_non_overlapping(left: DataFrame, right: DataFrame, min_overlap: float, on=(), **grid) -> DataFrame:
    """Left boxes whose best IoA against a right box reaches ``min_overlap``.

    The IoA divides by the area of the left box. Identical right boxes are merged
    first, so copies cost nothing.
    """
    keys = [*on, *BOX]
    hits = (
        box_pairs(left.select(*keys).distinct(), right.select(*keys).distinct(), on, **grid)
        .where(ioa(Box.of("b"), Box.of("a")) >= min_overlap)
        .select("a.*")
        .distinct()
    )
    return left.join(hits, keys, "left_semi")


def drop_overlapping(left: DataFrame, right: DataFrame, on=(), **grid) -> DataFrame:
    """Left boxes that do not intersect any right box (ignore-region filter)."""
    keys = [*on, *BOX]
    hits = (
        box_pairs(left.select(*keys).distinct(), right.select(*keys).distinct(), on, **grid)
        .select("a.*")
        .distinct()
    )
    return left.join(hits, keys, "left_anti")


def best_match(
    left: DataFrame,
    right: DataFrame,
    id_col: str,
    on=(),
    score=iou,
    plus: int = 0,
    carry=(),
    **grid,
) -> DataFrame:
    """For each left row the right row of highest overlap; ties take the lowest id.

    Copies of a box are merged on both sides before the join: equal right boxes
    tie, so only their lowest id can win, and equal left boxes share one answer.
    The winner comes from an aggregate with map-side combine, not from a sort.
    Adds ``id_col``, the ``carry`` columns and ``overlap`` (null when nothing
    intersects).
    """
    keys = [*on, *BOX]
    right = right.groupBy(*keys).agg(
        F.min(F.struct(id_col, *carry)).alias("_pick")
    ).select(*keys, "_pick")
    wide = box_pairs(
        _pad(left.select(*keys).distinct(), plus), _pad(right, plus), on, **grid
    )
    p, q = Box.of("a"), Box.of("b")
    value = score(p, q, 0) if score is iou else score(p, q)
    best = (
        wide.withColumn("_ov", value)
        .where("_ov > 0")
        .groupBy(*on, *(F.col(f"a.{c}").alias(c) for c in BOX))
        .agg(
            F.max(
                F.struct("_ov", (-F.col(f"b._pick.{id_col}")).alias("_neg"), F.col("b._pick").alias("_pick"))
            ).alias("_best")
        )
        .withColumn("xmax", F.col("xmax") - plus)
        .withColumn("ymax", F.col("ymax") - plus)
        .select(*keys, F.col("_best._ov").alias("overlap"), "_best._pick.*")
    )
    return left.join(best, keys, "left")


def _pad(df: DataFrame, plus: int) -> DataFrame:
    """Pixel-inclusive boxes: [xmin, xmax] covers xmax - xmin + 1 pixels."""
    if not plus:
        return df
    return df.withColumn("xmax", F.col("xmax") + plus).withColumn("ymax", F.col("ymax") + plus)


def near_vectors(left: DataFrame, right: DataFrame, max_sq_dist: float, on=()) -> DataFrame:
    """Pairs of box vectors whose squared L2 distance is at most ``max_sq_dist``.

    Bounding the distance turns the all-pairs matrix into a grid join on the
    first corner: corners further apart than the radius cannot qualify.
    """
    r = float(max_sq_dist) ** 0.5
    on = list(on)
    p, q = _box("a"), _box("b")
    a = _flat(left, on, "a").withColumns({"_cx": F.floor(p.xmin / r), "_cy": F.floor(p.ymin / r)})
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    b = (
        _flat(right, on, "b")
        .withColumn("_cx", F.explode(F.transform(around, lambda i: F.floor(q.xmin / r) + i)))
        .withColumn("_cy", F.explode(F.transform(around, lambda i: F.floor(q.ymin / r) + i)))
    )
    return (
        a.join(many(b), [*on, "_cx", "_cy"])
        .withColumn("sq_dist", sq_dist(p, q))
        .where(F.col("sq_dist") <= max_sq_dist)
        .select(*on, _side("a", left.columns), _side("b", right.columns), "sq_dist")
    )
