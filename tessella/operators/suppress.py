"""Non-maximum suppression, box voting and fusion of tile detections.

Greedy suppression keeps a row exactly when no kept better row overlaps it. That
answer is reached without a sequential scan: rows nobody better can suppress are
kept, the rows they suppress are dropped, and this repeats on what is left; long
chains are solved by connected components of bounded size (``conflict``).

Three steps keep the candidate pairs few in crowded places. Copies of one box are
merged into their best row first. Boxes meet only on grid levels that the IoU
threshold allows, so a wide box does not draw all small ones into its cell. Then
the boxes that lead every cell they touch are kept, and what they suppress is
dropped, before the other pairs are formed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.boxes import BOX, Box, intersection, iou, window
from ..runtime import many, stage
from . import boxes as ob
from .conflict import greedy_losers
from .nearest import within_radius
from .ordering import numbered, top_per_key
from .overlap import _emit, _level, _pad, box_pairs, iou_span


def _merge_copies(df: DataFrame, keys, priority: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Best row of each distinct box; boxes of no area never suppress anything."""
    solid = df.where("xmax > xmin AND ymax > ymin")
    flat = df.where("NOT (xmax > xmin AND ymax > ymin)")
    best = solid.groupBy(*keys, *BOX).agg(F.max(F.struct(F.col(priority).alias("p"), (-F.col(id_col)).alias("n"))).alias("_b"))
    return best.select(*keys, *BOX, F.col("_b.p").alias("_p"), (-F.col("_b.n")).alias("_id")), flat


def _thin(live: DataFrame, keys, overlaps, cell: float, top: Column | None, span: int | None):
    """Settle the leaders of the cells; returns the rows left and the ids kept."""
    place = [*keys, "_level", "_cx", "_cy"]
    cells = _emit(live, keys, "a", cell, top, span).select(*place, F.col("_a__p").alias("_p"), F.col("_a__id").alias("_id")).distinct()
    lead = cells.groupBy(*place).agg(F.max(F.struct("_p", (-F.col("_id")).alias("n"))).alias("_b"))
    leads = many(cells).join(lead, place).groupBy("_id").agg(F.bool_and(-F.col("_b.n") == F.col("_id")).alias("safe"))
    safe = stage(live.join(leads.where("safe").select("_id"), "_id", "left_semi"), "safe")
    dead = _edges(safe, live, keys, overlaps, cell, top, span).select(F.col("loser").alias("_id"))
    gone = safe.select("_id").unionByName(dead).distinct()
    return stage(live.join(gone, "_id", "left_anti"), "live"), safe.select("_id")


def _edges(left: DataFrame, right: DataFrame, keys, overlaps, cell, top, span) -> DataFrame:
    pairs = box_pairs(left, right, keys, cell=cell, top=top, span=span)
    better = (F.col("a._p") > F.col("b._p")) | ((F.col("a._p") == F.col("b._p")) & (F.col("a._id") < F.col("b._id")))
    return pairs.where(better & overlaps(Box.of("a"), Box.of("b"))).select(
        F.col("a._id").alias("winner"), F.col("b._id").alias("loser")
    )


def nms(
    df: DataFrame,
    threshold: float,
    keys=(),
    id_col: str = "det_id",
    priority: str = "score",
    overlaps=None,
    max_output: int | None = None,
    cell: float = 64.0,
) -> DataFrame:
    """Greedy suppression per key: IoU above ``threshold`` drops the worse row.

    Order is ``priority`` descending, then ``id_col``; ids are unique.
    ``overlaps(better, worse)`` may replace the IoU rule; it must hold for
    identical boxes. A threshold of 1 or more suppresses nothing.
    """
    keys, span = list(keys), None
    if overlaps is None:
        if threshold >= 1:
            return _best(df, keys, id_col, priority, max_output)
        span = iou_span(threshold)
        overlaps = lambda a, b: iou(a, b) > threshold
    nodes, flat = _merge_copies(df, keys, priority, id_col)
    nodes = stage(nodes, "nodes")
    widest = nodes.agg(F.max(_level(Box.of(), cell)).alias("top")).first()["top"]
    top = F.lit(widest) if widest else None
    live, kept = _thin(nodes, keys, overlaps, cell, top, span)
    losers = greedy_losers(_edges(live, live, keys, overlaps, cell, top, span))
    winners = live.select("_id").join(losers.select(F.col("loser").alias("_id")), "_id", "left_anti").unionByName(kept)
    winners = winners.select(F.col("_id").alias(id_col)).unionByName(flat.select(id_col))
    return _best(df.join(winners, id_col, "left_semi"), keys, id_col, priority, max_output)


def _best(df, keys, id_col, priority, max_output):
    if max_output is None:
        return df
    return top_per_key(df, keys, [F.col(priority).desc(), F.col(id_col)], max_output, "_rank").drop("_rank")


def nms_by_ymax(df: DataFrame, threshold: float, keys=(), id_col: str = "det_id", **grid) -> DataFrame:
    """Older rule: lowest box on the page first; pixel-inclusive intersection over the area of the other box."""
    rule = lambda a, b: intersection(a, b) / b.area() > threshold
    kept = nms(_pad(df, 1), threshold, keys, id_col, "ymax", rule, **grid)
    return df.join(kept.select(id_col), id_col, "left_semi")


def nms_multiclass(
    df: DataFrame, threshold: float, score_threshold: float, max_per_class: int, max_total: int,
    image: str = "image_id", class_id: str = "class_id", id_col: str = "det_id", clip: Box | None = None, **grid,
) -> DataFrame:
    """Score filter, suppression per image and class, optional clip, best ``max_total`` per image."""
    kept = nms(ob.score_filter(df, score_threshold), threshold, [image, class_id], id_col, max_output=max_per_class, **grid)
    if clip is not None:
        kept = ob.clip(kept, clip)
    return _best(kept, [image], id_col, "score", max_total)


def dealt(df: DataFrame, keys, most: int = 20_000) -> list[DataFrame]:
    """Rows of the keys with up to ``most`` rows, dealt by key, and if there are crowded keys, their rows as they are.

    What is made of a dealt table and grouped or joined within its keys is not shuffled again, and a task holds whole keys.
    """
    crowded = stage(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys), "crowded")
    if crowded.isEmpty():
        return [df.repartition(*keys)]
    return [df.join(many(crowded), list(keys), "left_anti").repartition(*keys), df.join(many(crowded), list(keys), "left_semi")]


def _mask_edges(df: DataFrame, pixels: DataFrame, threshold: float, keys, id_col: str) -> DataFrame:
    """Edges ``(keys, winner, loser)`` of masks whose IoU is above the threshold; each pair meets once, better mask first."""
    from .masks import blocks

    known = [c for c in pixels.columns if c in (*keys, id_col, "score")]
    masks, place = [*keys, id_col, "score"], [*keys, "_by", "_bx"]
    tagged, listed = blocks(pixels, known), set(known) == set(masks)
    if not listed:
        known = [c for c in known if c != "score"]
        tagged = stage(tagged.join(df.select(*masks).distinct(), known), "blocks")
    tagged = tagged.withColumn("_area", F.sum(F.bit_count("_bits")).over(Window.partitionBy(*masks)))
    named = {"{}": id_col, "_{}": "score", "{}_area": "_area", "{}_bits": "_bits"}
    side = lambda s, at="": [F.col(f"{at}{c}").alias(k.format(s)) for k, c in named.items()]
    if listed:  # a join on the block would deal them again
        each = [*(k.format("winner") for k in named)]
        pairs = tagged.where(" AND ".join(f"`{k}` IS NOT NULL" for k in (*place, "score"))).groupBy(*place).agg(F.collect_list(F.struct(id_col, "score", "_area", "_bits")).alias("_all"))
        pairs = pairs.withColumn("_m", F.explode("_all")).select(*keys, "_all", *side("winner", "_m."))
        pairs = pairs.withColumn("_m", F.explode("_all")).select(*keys, *each, *side("loser", "_m."))
    else:
        pairs = many(tagged.select(*place, *side("winner"))).join(tagged.select(*place, *side("loser")), place)
    pairs = pairs.where("winner <> loser AND (_winner > _loser OR (_winner = _loser AND winner < loser)) AND winner_bits & loser_bits <> 0")
    common = F.bit_count(F.col("winner_bits").bitwiseAND(F.col("loser_bits"))).cast("long")
    shared = pairs.groupBy(*keys, "winner", "loser", "_winner", "_loser", "winner_area", "loser_area").agg(F.sum(common).alias("_n"))
    return shared.where(F.col("_n") / (F.col("winner_area") + F.col("loser_area") - F.col("_n")) > threshold).select(*keys, "winner", "loser")


def nms_masks(
    df: DataFrame, pixels: DataFrame | list[DataFrame], threshold: float, keys=("image_id",), id_col: str = "det_id", max_output: int | None = None
) -> DataFrame:
    """Suppression on mask IoU; ``pixels`` is ``(image_id, id_col, y, x)``.

    With a column ``score`` the pixels are taken for those of rows of ``df``, whose score it is, and the masks of a block meet
    in a list: made of ``dealt`` rows, they meet where they are. Several tables may be given, each key in one of them.
    """
    keys = list(keys)
    edges = [stage(_mask_edges(df, p, threshold, keys, id_col).distinct(), "edges") for p in (pixels if isinstance(pixels, list) else [pixels])]
    losers = greedy_losers(reduce(DataFrame.unionByName, edges), keys).select(F.col("loser").alias(id_col))
    return _best(df.join(losers, id_col, "left_anti"), keys, id_col, "score", max_output)


def box_vote(kept: DataFrame, pool: DataFrame, threshold: float, keys=("image_id",), id_col: str = "det_id", **grid) -> DataFrame:
    """Move each kept box to the score-weighted mean of the pool boxes overlapping it.

    The new score is the mean pool score; a box whose pool scores are all zero stays. Pool copies are summed before the join.
    """
    keys = list(keys)
    merged = pool.groupBy(*keys, *BOX).agg(F.sum("score").alias("_w"), F.count("*").alias("_n"))
    pairs = box_pairs(kept.select(*keys, id_col, *BOX), merged, keys, span=iou_span(threshold), **grid)
    hit = pairs.where(iou(Box.of("a"), Box.of("b")) > threshold)
    weight = F.sum("b._w")
    voted = hit.groupBy(*keys, F.col(f"a.{id_col}").alias(id_col)).agg(
        *(F.coalesce(F.try_divide(F.sum(F.col(f"b.{c}") * F.col("b._w")), weight), F.any_value(f"a.{c}")).alias(c) for c in BOX),
        (weight / F.sum("b._n")).alias("score"),
    )
    rest = [c for c in kept.columns if c not in (*keys, id_col, *BOX, "score")]
    return voted.join(kept.select(*keys, id_col, *rest), [*keys, id_col])


def refine_boxes(df: DataFrame, nms_threshold: float, vote_threshold: float, keys=("image_id", "class_id"), id_col: str = "det_id", max_output: int | None = None, **grid) -> DataFrame:
    """Suppression followed by voting, per key."""
    kept = nms(df, nms_threshold, keys, id_col, max_output=max_output)
    return box_vote(kept, df, vote_threshold, keys, id_col, **grid)


def remove_close_centers(df: DataFrame, radius: float = 3, on=(), x: str = "centroid_x", y: str = "centroid_y", id_col: str = "det_id", score: str = "score") -> DataFrame:
    """Drop every row that is not the best of some ball of the given radius.

    Balls are centred on every row and include their edge; one pass, so a chain
    can lose several members. The best row per location stands for its copies,
    which turns the ball into a join of distinct locations.
    """
    on = list(on)
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(id_col)).alias("n")))
    sites = stage(df.groupBy(*on, x, y).agg(best.alias("b")).select(*on, x, y, "b.s", "b.n"), "sites")
    side = lambda p: sites.select(*on, F.col(x).alias(f"{p}x"), F.col(y).alias(f"{p}y"), F.col("s").alias(f"{p}_s"), F.col("n").alias(f"{p}_n"))
    balls = within_radius(side("a"), side("b"), radius, on)
    lead = balls.groupBy(*on, "ax", "ay").agg(F.max(F.struct("b_s", "b_n")).alias("_lead"))
    lead = lead.select(*on, "ax", "ay", F.col("_lead.b_n").alias("lead"))
    seen = balls.select(*on, "ax", "ay", "bx", "by", "b_n").join(lead, [*on, "ax", "ay"])
    keep = seen.groupBy(*on, "bx", "by", "b_n").agg(F.bool_and(F.col("lead") == F.col("b_n")).alias("ok"))
    return df.join(keep.where("ok").select((-F.col("b_n")).alias(id_col)), id_col, "left_semi")


def fuse_tiles(
    det: DataFrame, tile: int, score_threshold: float = 0.5, iou_threshold: float = 0.5, max_side: int = 100,
    edge: int = 0, radius: float = 3, on=(),
) -> DataFrame:
    """Per-tile normalised detections to one global box table.

    ``det``: ``det_id, tile_x, tile_y, score`` and a box in tile units. Steps:
    score filter, suppression inside the tile, pixels, size and edge filters,
    shift, truncation to integers, close centres, global suppression, ids in
    score order.
    """
    on = list(on)
    rows = ob.score_filter(det, score_threshold)
    rows = nms(rows, iou_threshold, [*on, "tile_y", "tile_x"], cell=0.25)
    rows = ob.scale(rows, tile, tile)
    rows = ob.size_filter(rows, max_side=max_side)
    rows = ob.inside(rows, window(edge, edge, tile - edge, tile - edge))
    rows = ob.put(rows, Box.of().shift(F.col("tile_x"), F.col("tile_y")))
    rows = rows.withColumns({c: F.col(c).cast("long") for c in BOX}).withColumns(
        {"centroid_x": F.floor((F.col("xmin") + F.col("xmax")) / 2), "centroid_y": F.floor((F.col("ymin") + F.col("ymax")) / 2)}
    )
    rows = stage(rows, "global")
    rows = remove_close_centers(rows, radius, on)
    rows = nms(rows, iou_threshold, on)
    return numbered(rows, [F.col("score").desc(), F.col("det_id")], "ID")
