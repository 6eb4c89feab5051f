"""Overlap of pixel masks held as sparse pixel tables ``(keys, id, y, x)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


#: Side of the blocks whose pixels are the bits of one number.
SIDE = 8


def blocks(pixels: DataFrame, keys) -> DataFrame:
    """Pixel rows ``(keys, y, x)`` as ``(keys, _by, _bx, _bits)``: one row for each block of 8 x 8 that a mask touches, a bit for each pixel.

    Repeated pixels set one bit. A mask's rows combine before they are shuffled.
    """
    at = lambda c: F.floor(F.col(c) / SIDE)
    bit = F.pmod("y", F.lit(SIDE)) * SIDE + F.pmod("x", F.lit(SIDE))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))
    return pixels.groupBy(*keys, at("y").alias("_by"), at("x").alias("_bx")).agg(F.bit_or(one).alias("_bits"))


def block_overlap(left: DataFrame, right: DataFrame, a_id: str, b_id: str, on=("image_id",)) -> DataFrame:
    """Same as :func:`mask_overlap` on masks held as ``blocks``, one row for each key, mask and block."""
    on, block = list(on), ["_by", "_bx"]
    area = lambda df, k, name: df.groupBy(*on, k).agg(F.sum(F.bit_count("_bits")).alias(name))
    a = left.select(*on, *block, a_id, F.col("_bits").alias("_a"))
    b = right.select(*on, *block, b_id, F.col("_bits").alias("_b"))
    common = F.bit_count(F.col("_a").bitwiseAND(F.col("_b")))
    shared = (
        a.join(b, [*on, *block]).withColumn("_n", common.cast("long")).where("_n > 0")
        .groupBy(*on, a_id, b_id).agg(F.sum("_n").alias("intersection"))
    )
    return (
        shared.join(area(left, a_id, "area_a"), [*on, a_id])
        .join(area(right, b_id, "area_b"), [*on, b_id])
        .withColumn("iou", F.col("intersection") / (F.col("area_a") + F.col("area_b") - F.col("intersection")))
        .withColumn("ioa_a", F.col("intersection") / F.col("area_a"))
        .withColumn("ioa_b", F.col("intersection") / F.col("area_b"))
    )


def mask_overlap(a: DataFrame, b: DataFrame, a_id: str, b_id: str, on=("image_id",)) -> DataFrame:
    """Intersection, areas, IoU and both IoA for masks that share a pixel.

    The join key is a block of pixels, so work is spread evenly, and a pair of masks meets once
    in each block that both touch, not in each pixel.
    """
    return block_overlap(blocks(a, [*on, a_id]), blocks(b, [*on, b_id]), a_id, b_id, on)


def points_in_mask(points: DataFrame, mask: DataFrame, y: str = "y", x: str = "x", on=()) -> DataFrame:
    """Points whose pixel belongs to the mask."""
    cond = [F.floor(points[y]) == mask["y"], F.floor(points[x]) == mask["x"]]
    cond += [points[k] == mask[k] for k in on]
    return points.join(mask, cond, "left_semi")
