"""Matching of anchors to ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.boxes import BOX, Box, iou
from .conflict import one_to_one
from .overlap import best_match, box_pairs

UNMATCHED, IGNORED = -1, -2


def assign_targets(
    anchors: DataFrame, gt: DataFrame, matched: float = 0.7, unmatched: float | None = None,
    force: bool = False, on=("image_id",), anchor_id: str = "det_id", gt_id: str = "gt_id", **grid,
) -> DataFrame:
    """Best ground truth per anchor with its target box, class and weights.

    ``match`` is the ground-truth id, -1 below ``unmatched`` and -2 in between.
    ``force`` also gives every ground truth its best anchor (lowest anchor id on
    ties; if several claim one anchor the lowest ground truth wins).
    """
    on = list(on)
    low = matched if unmatched is None else unmatched
    carry = ["class_id", *BOX]
    g = gt.select(*on, gt_id, *BOX, F.col("class_id").alias("gt_class"))
    a = anchors.select(*on, anchor_id, *BOX)
    best = best_match(a, g, gt_id, on, carry=["gt_class"], **grid)
    best = best.withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    match = (
        F.when(F.col("overlap") >= matched, F.col(gt_id))
        .when(F.col("overlap") >= low, F.lit(IGNORED))
        .otherwise(F.lit(UNMATCHED))
    )
    out = best.select(*on, anchor_id, "overlap", match.alias("match"))
    if force:
        forced = (
            best_match(g, a, anchor_id, on, **grid)
            .where(F.col(anchor_id).isNotNull())
            .groupBy(*on, anchor_id)
            .agg(F.min(gt_id).alias("_forced"))
        )
        out = out.join(forced, [*on, anchor_id], "left").withColumn("match", F.coalesce("_forced", "match")).drop("_forced")
    target = gt.select(*on, F.col(gt_id).alias("match"), *(F.col(c).alias(f"target_{c}") for c in carry))
    return (
        out.join(target, [*on, "match"], "left")
        .withColumn("target_class_id", F.coalesce("target_class_id", F.lit(0)))
        .withColumn("box_weight", (F.col("match") >= 0).cast("double"))
        .withColumn("class_weight", (F.col("match") != IGNORED).cast("double"))
    )


def bipartite_greedy(left: DataFrame, right: DataFrame, left_id: str, right_id: str, on=("image_id",), **grid) -> DataFrame:
    """Greedy one-to-one matching: globally best pair first, each side used once.

    Only intersecting pairs take part.
    """
    on = list(on)
    pairs = box_pairs(left.select(*on, left_id, *BOX), right.select(*on, right_id, *BOX), on, **grid)
    edges = pairs.select(
        *on, F.col(f"a.{left_id}").alias("l"), F.col(f"b.{right_id}").alias("r"), iou(Box.of("a"), Box.of("b")).alias("v")
    )
    return one_to_one(edges, on).select(*on, F.col("l").alias(left_id), F.col("r").alias(right_id), F.col("v").alias("overlap"))
