"""Keypoint expressions; a missing keypoint is NaN in both coordinates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .boxes import Box

NAN = float("nan")


def scale(y: Column, x: Column, sy, sx):
    return y * sy, x * sx


def clip(y: Column, x: Column, w: Box):
    return F.greatest(F.least(y, w.ymax), w.ymin), F.greatest(F.least(x, w.xmax), w.xmin)


def prune_outside(y: Column, x: Column, w: Box):
    inside = (y >= w.ymin) & (y <= w.ymax) & (x >= w.xmin) & (x <= w.xmax)
    return F.when(inside, y).otherwise(F.lit(NAN)), F.when(inside, x).otherwise(F.lit(NAN))


def change_frame(y: Column, x: Column, w: Box):
    """Coordinates relative to the window, in units of its size."""
    return (y - w.ymin) / w.height(), (x - w.xmin) / w.width()


def normalize(y: Column, x: Column, height, width):
    return y / height, x / width


def absolute(y: Column, x: Column, height, width):
    return y * height, x * width


def flip_horizontal(y: Column, x: Column, at=0.5):
    return y, 2 * at - x


def flip_vertical(y: Column, x: Column, at=0.5):
    return 2 * at - y, x


def rot90(y: Column, x: Column):
    """Rotate normalised keypoints by 90 degrees counter-clockwise."""
    return 1 - x, y


def permute(index: Column, order: list[int]) -> Column:
    """New position of keypoint ``index`` when ``order[new] = old``."""
    where = {old: new for new, old in enumerate(order)}
    return F.create_map(*(F.lit(v) for pair in sorted(where.items()) for v in pair))[index]
