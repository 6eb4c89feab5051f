"""Cell patches: crop with a margin, pad to a common square, resize."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.boxes import Box
from .ordering import top_per_key


def resize(a: np.ndarray, size: int, side: int | None = None, top: int = 0, left: int = 0) -> np.ndarray:
    """Bilinear resize of a square of ``side`` that holds ``a`` at (top, left) and is zero elsewhere, and outside."""
    h, w = a.shape
    n = h if side is None else side
    at = (np.arange(size) + 0.5) * n / size - 0.5
    low = np.floor(at).astype(int)
    f = at - low
    p = np.pad(a, 1)
    places = lambda shift, length: [np.clip(low - shift + k, -1, length) + 1 for k in (0, 1)]
    (y0, y1), (x0, x1) = places(top, h), places(left, w)
    rows = p[y0] * (1 - f)[:, None] + p[y1] * f[:, None]
    return rows[:, x0] * (1 - f) + rows[:, x1] * f


def _cut(keys: list[str], pixels: pd.DataFrame, boxes: pd.DataFrame, block: int) -> pd.DataFrame:
    """What one block of an image holds of each box: the image block is built once for each channel."""
    rows = []
    if len(pixels) and len(boxes):
        oy, ox = int(boxes["tile_y"].iloc[0]) * block, int(boxes["tile_x"].iloc[0]) * block
        for channel, px in pixels.groupby("channel"):
            values, there = np.zeros((block, block)), np.zeros((block, block), bool)
            at = px["y"].to_numpy() - oy, px["x"].to_numpy() - ox
            values[at], there[at] = px["value"], True
            for b in boxes.itertuples(index=False):
                y0, x0 = max(b.ymin - oy, 0), max(b.xmin - ox, 0)
                part = np.s_[y0 : b.ymax - oy, x0 : b.xmax - ox]
                if there[part].any():
                    piece = values[part]
                    rows.append((*(getattr(b, k) for k in keys), channel, y0 + oy - b.ymin, x0 + ox - b.xmin, piece.shape[1], piece.ravel()))
    return pd.DataFrame(rows, columns=[*keys, "channel", "y", "x", "w", "values"])


def _assemble(keys: list[str], pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    """Patches of all boxes that begin in one block, from their pieces."""
    rows = []
    for name, parts in pdf.groupby([*keys, "channel"], sort=False, dropna=False):
        d, h, w = (int(parts[c].iloc[0]) for c in ("_dim", "_h", "_w"))
        a = np.zeros((h, w))
        for p in parts.itertuples(index=False):
            piece = np.asarray(p.values).reshape(-1, p.w)
            a[p.y : p.y + piece.shape[0], p.x : p.x + p.w] = piece
        rows.append((*name, resize(a, size, d, -(-(d - h) // 2), -(-(d - w) // 2)).ravel()))
    return pd.DataFrame(rows, columns=[*keys, "channel", "patch"])


def extract(boxes: DataFrame, pixels: DataFrame, height: int, width: int, margin: int = 0, size: int = 50, on=(), block: int = 256) -> DataFrame:
    """``(on, ID, channel, patch)`` with row-major ``size * size`` patches; ``on`` names the image.

    All patches are padded to the largest cell before resizing, which the resize
    takes into account without building the square. Image blocks are built once and
    cut for all their boxes; a task then holds the boxes that begin in one block.
    """
    keys = [*on, "ID"]
    b = Box.of().grow(margin, width, height)
    grown = boxes.select(*keys, *(c.alias(n) for n, c in b.columns().items())).where("xmax > xmin AND ymax > ymin")
    h, w = F.col("ymax") - F.col("ymin"), F.col("xmax") - F.col("xmin")
    home = {"_by": F.floor(F.col("ymin") / block), "_bx": F.floor(F.col("xmin") / block)}
    dim = grown.agg(F.max(F.greatest(h, w)).alias("d")).scalar()
    sized = grown.select(*keys, h.alias("_h"), w.alias("_w"), *(c.alias(n) for n, c in home.items())).withColumn("_dim", dim)
    tiles = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / block), F.floor((F.col(hi) - 1) / block)))
    spread = grown.withColumn("tile_y", tiles("ymin", "ymax")).withColumn("tile_x", tiles("xmin", "xmax"))
    place = [*on, "tile_y", "tile_x"]
    px = pixels.select(
        *on, "channel", "y", "x", "value", F.floor(F.col("y") / block).alias("tile_y"), F.floor(F.col("x") / block).alias("tile_x")
    )
    kinds = ", ".join(f"{k} {dict(boxes.dtypes)[k]}" for k in keys) + f", channel {dict(pixels.dtypes)['channel']}"
    pieces = px.groupBy(*place).cogroup(spread.groupBy(*place)).applyInPandas(
        lambda p, q: _cut(keys, p, q, block), f"{kinds}, y long, x long, w long, values array<double>"
    )
    return pieces.join(sized, keys).groupBy(*on, "_by", "_bx").applyInPandas(
        lambda pdf: _assemble(keys, pdf, size), f"{kinds}, patch array<double>"
    )


def brightest(zonal: DataFrame, n: int) -> DataFrame:
    return top_per_key(zonal, ["channel"], [F.col("mean").desc(), F.col("ID")], n)
