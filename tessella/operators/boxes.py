"""Box table operators: projections, filters and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.boxes import BOX, Box, window


def put(df: DataFrame, box: Box, names=BOX) -> DataFrame:
    """Replace the box columns of ``df``."""
    return df.withColumns(box.columns(names))


def checked(value: Column, ok: Column, message: str) -> Column:
    """``value``, or an error at run time where ``ok`` is false."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def scale(df: DataFrame, y: float, x: float) -> DataFrame:
    return put(df, Box.of().scale(y, x))


def normalize(df: DataFrame, height: float, width: float, limit: float = 1.01) -> DataFrame:
    """Pixels to [0, 1]; a result beyond ``limit`` is an error."""
    box = Box.of().scale(1.0 / height, 1.0 / width)
    ok = F.greatest(box.xmax, box.ymax) <= limit
    return put(df, Box(*(checked(c, ok, "box exceeds the image") for c in box.columns().values())))


def absolute(df: DataFrame, height: float, width: float, limit: float = 1.1) -> DataFrame:
    """[0, 1] to pixels; an input beyond ``limit`` is an error."""
    src = Box.of()
    ok = F.greatest(src.xmax, src.ymax) <= limit
    box = src.scale(float(height), float(width))
    return put(df, Box(*(checked(c, ok, "box is not normalised") for c in box.columns().values())))


def clip(df: DataFrame, win: Box, drop_empty: bool = True) -> DataFrame:
    out = put(df, Box.of().clip(win))
    return out.where(Box.of().area() > 0) if drop_empty else out


def change_frame(df: DataFrame, win: Box) -> DataFrame:
    return put(df, Box.of().change_frame(win))


def sanitize(df: DataFrame) -> DataFrame:
    """Swap inverted corners, clamp to the unit square, drop empty boxes."""
    return put(df, Box.of().sanitize()).where("xmin < xmax AND ymin < ymax")


def to_local(df: DataFrame, corner_x: Column, corner_y: Column) -> DataFrame:
    return put(df, Box.of().shift(-corner_x, -corner_y))


def to_global(df: DataFrame, corner_x: Column, corner_y: Column, height: float = 1, width: float = 1) -> DataFrame:
    """Tile coordinates (times the tile size when normalised) to image coordinates."""
    return put(df, Box.of().scale(height, width).shift(corner_x, corner_y))


def truncate(df: DataFrame, height: int, width: int) -> DataFrame:
    """Flag boxes that cross the tile edge, then clip those to [1, size - 1]."""
    b = Box.of()
    cut = (b.xmin < 0) | (b.ymin < 0) | (b.xmax > width) | (b.ymax > height)
    clipped = b.clip(window(1, 1, width - 1, height - 1))
    flagged = df.withColumn("truncated", cut.cast("int"))
    return flagged.withColumns(
        {n: F.when(F.col("truncated") == 1, c).otherwise(F.col(n)) for n, c in clipped.columns().items()}
    )


def mirror_downscale(df: DataFrame, height: int, rate: float, x: str = "centroid_x", y: str = "centroid_y") -> DataFrame:
    """Mirror y and add down-sampled centres (truncated)."""
    mirrored = df.withColumn(y, F.lit(height) - F.col(y))
    return mirrored.withColumns({f"{c}_ds": (F.col(c) / rate).cast("long") for c in (x, y)})


def offset(df: DataFrame, dx: int, dy: int) -> DataFrame:
    """Shift boxes and centres by a crop origin."""
    out = put(df, Box.of().shift(dx, dy))
    return out.withColumns({"centroid_x": F.col("centroid_x") + dx, "centroid_y": F.col("centroid_y") + dy})


# --------------------------------------------------------------------- filters


def center_in(df: DataFrame, win: Box, closed_low: bool, x: str = "centroid_x", y: str = "centroid_y") -> DataFrame:
    """Centre inside the tile; ``closed_low`` includes the low edges."""
    cx, cy = F.col(x), F.col(y)
    low = (cx >= win.xmin) & (cy >= win.ymin) if closed_low else (cx > win.xmin) & (cy > win.ymin)
    return df.where(low & (cx < win.xmax) & (cy < win.ymax))


def inside(df: DataFrame, win: Box, edge: str = "closed") -> DataFrame:
    if edge not in ("closed", "half_open"):
        raise ValueError("edge must be 'closed' or 'half_open'")
    b = Box.of()
    return df.where(b.inside(win) if edge == "closed" else b.inside_half_open(win))


def not_outside(df: DataFrame, win: Box) -> DataFrame:
    return df.where(~Box.of().outside(win))


def inside_margin(df: DataFrame, height: int, width: int, margin: int, markers=()) -> DataFrame:
    """Boxes away from the image border; with markers, only rows positive for one."""
    out = df.where(Box.of().inside(window(margin, margin, width - margin, height - margin)))
    return out.where(F.greatest(*(F.col(m) for m in markers)) > 0) if len(markers) > 1 else (
        out.where(F.col(markers[0]) > 0) if markers else out
    )


def size_filter(df: DataFrame, max_side: float | None = None, over: float | None = None, at_least: float | None = None) -> DataFrame:
    """Longest side below ``max_side``; shortest above ``over`` or at least ``at_least``."""
    b = Box.of()
    w, h = b.width(), b.height()
    if max_side is not None:
        df = df.where((w < max_side) & (h < max_side))
    if over is not None:
        df = df.where((w > over) & (h > over))
    if at_least is not None:
        df = df.where((w >= at_least) & (h >= at_least))
    return df


def score_filter(df: DataFrame, threshold: float, keep_nan: bool = False, score: str = "score") -> DataFrame:
    """Scores above the threshold; optionally also boxes without a score (NaN)."""
    s = F.col(score)
    above = (s > threshold) & ~F.isnan(s)
    return df.where(above | F.isnan(s)) if keep_nan else df.where(above)


def field_equals(df: DataFrame, field: str, value) -> DataFrame:
    return df.where(F.col(field) == value)


def gather(df: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed in ``index``."""
    return df.join(index.select(key).distinct(), key, "left_semi")


def valid_report(df: DataFrame, height: float, width: float) -> DataFrame:
    """Counts of kept and skipped boxes, by reason, in one pass."""
    b = Box.of()
    empty = (b.xmin >= b.xmax) | (b.ymin >= b.ymax)
    outside = (b.xmin < 0) | (b.ymin < 0) | (b.xmax > width) | (b.ymax > height)
    return df.agg(
        F.count_if(empty).alias("skipped_empty"),
        F.count_if(~empty & outside).alias("skipped_outside"),
        F.count_if(~empty & ~outside).alias("kept"),
    )


def valid(df: DataFrame, height: float, width: float) -> DataFrame:
    return df.where("xmin < xmax AND ymin < ymax").where(Box.of().inside(window(0, 0, width, height)))


def clean_groundtruth(df: DataFrame) -> DataFrame:
    """Drop crowd boxes, NaN coordinates and non-positive classes; NaN label score is 1."""
    good = ~F.col("is_crowd") & (F.col("class_id") > 0)
    for c in BOX:
        good = good & ~F.isnan(c)
    return df.where(good).withColumn("label_score", F.nanvl("label_score", F.lit(1.0)))


def keep_classes(df: DataFrame, classes: DataFrame, column: str = "class_id") -> DataFrame:
    return df.join(classes.select(column).distinct(), column, "left_semi")


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop every column that holds a null; one pass finds them all."""
    holes = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if holes[c] == 0))


def split_box_label_rows(df: DataFrame, box_column: str = "XMin", label_column: str = "ConfidenceImageLabel"):
    """Box rows and image-label rows of one mixed table."""
    return df.where(F.col(label_column).isNull()), df.where(F.col(box_column).isNull())


# -------------------------------------------------------------- set operations


def union(*frames: DataFrame) -> DataFrame:
    """Concatenate box tables that have exactly the same fields."""
    first = frames[0]
    for other in frames[1:]:
        if set(other.columns) != set(first.columns):
            raise ValueError(f"fields differ: {sorted(first.columns)} and {sorted(other.columns)}")
    out = first
    for other in frames[1:]:
        out = out.unionByName(other)
    return out


def except_rows(df: DataFrame, removed: DataFrame, on) -> DataFrame:
    return df.join(removed, list(on), "left_anti")


def members(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``df`` that also occur, in full, in ``other``."""
    return df.join(other, df.columns, "left_semi")


def reject_duplicates(df: DataFrame, key: str, on_duplicate: str = "first", order: str | None = None) -> DataFrame:
    """Keep the first record of each key, or fail when a key repeats."""
    if on_duplicate == "error":
        n = df.groupBy(key).agg(F.count("*").alias("_n"))
        return df.join(n, key).withColumn(
            key, checked(F.col(key), F.col("_n") == 1, f"duplicate {key}")
        ).drop("_n")
    first = df.groupBy(key).agg(F.min(order).alias(order))
    return df.join(first, [key, order], "left_semi")


def cover_box(df: DataFrame, keys=(), default=(0.0, 0.0, 1.0, 1.0)) -> DataFrame:
    """Smallest box that covers all boxes; ``default`` when there are none."""
    ends = [F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")]
    cols = [F.coalesce(e, F.lit(d)).alias(n) for e, d, n in zip(ends, default, BOX)]
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def merge_multilabel(df: DataFrame, n_classes: int, keys=("image_id",), index: str = "idx") -> DataFrame:
    """One row per distinct box with k-hot class columns and the first index."""
    hot = [F.max((F.col("class_id") == i).cast("int")).alias(f"class_{i}") for i in range(n_classes)]
    return df.groupBy(*keys, *BOX).agg(*hot, F.min(index).alias(index))


def limit_detections(df: DataFrame, per_class: int, total: int, keys=("image_id",)) -> DataFrame:
    """Best ``per_class`` per image and class, then best ``total`` per image."""
    from .ordering import top_per_key

    order = [F.col("score").desc(), F.col("det_id")]
    one = top_per_key(df, [*keys, "class_id"], order, per_class, "_c")
    return top_per_key(one, list(keys), order, total, "rank").drop("_c")
