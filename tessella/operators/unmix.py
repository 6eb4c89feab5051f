"""Channel un-mixing: fit weights from sums over pixels, subtract weighted channels.

Only sums over pixels leave the executors: a Gram matrix of the channels of one
round (about ten by ten), never pixels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.boxes import Box
from ..functions.pixels import DTYPE_MAX, stretch
from .ordering import top_per_key
from .raster import image_stats, to_dtype


def in_roi(pixels: DataFrame, roi: Box | None) -> DataFrame:
    if roi is None:
        return pixels
    return pixels.where((F.col("y") >= roi.ymin) & (F.col("y") < roi.ymax) & (F.col("x") >= roi.xmin) & (F.col("x") < roi.xmax))


def gram(pixels: DataFrame, channels, scale: float = 1.0, on=()) -> DataFrame:
    """Sums over pixels: ``n``, ``m_i`` per channel and ``g_i_j`` per channel pair, in one row.

    ``pixels`` is long ``(on, channel, y, x, value)``, ``on`` naming the image; ``scale`` divides values (the
    type's maximum turns integers into fractions).
    """
    channels = list(channels)
    wide = pixels.groupBy(*on, "y", "x").agg(
        *(F.coalesce(F.max(F.when(F.col("channel") == c, F.col("value"))), F.lit(0)).cast("double").alias(f"c{i}") for i, c in enumerate(channels))
    )
    v = [F.col(f"c{i}") / scale for i in range(len(channels))]
    return wide.agg(
        F.count("*").alias("n"),
        *(F.sum(v[i]).alias(f"m_{i}") for i in range(len(v))),
        *(F.sum(v[i] * v[j]).alias(f"g_{i}_{j}") for i in range(len(v)) for j in range(i, len(v))),
    )


def _positive_lasso(cov: np.ndarray, target: np.ndarray, alpha: float, rounds: int = 10000, tol: float = 1e-12) -> np.ndarray:
    """Coordinate descent for min 1/2 w'Cw - t'w + alpha * sum(w), w >= 0."""
    w = np.zeros(len(target))
    for _ in range(rounds):
        before = w.copy()
        for i in range(len(w)):
            if cov[i, i] <= 0:
                continue
            rest = target[i] - cov[i] @ w + cov[i, i] * w[i]
            w[i] = max(0.0, (rest - alpha) / cov[i, i])
        if np.max(np.abs(w - before), initial=0.0) < tol:
            break
    return w


def fit_lasso(pixels: DataFrame, channels, roi: Box | None = None, alpha: float = 1e-4, scale: float = 65535.0, on=()) -> DataFrame:
    """Positive LASSO with intercept of each channel on the others, as ``(target, channel, weight)``.

    The sums are centred with the means, which is what fitting an intercept does.
    """
    channels = list(channels)
    k = len(channels)
    row = gram(in_roi(pixels, roi), channels, scale, on).first()
    n = row["n"]
    mean = np.array([row[f"m_{i}"] for i in range(k)]) / n
    g = np.array([[row[f"g_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / n
    cov = g - np.outer(mean, mean)
    out = []
    for i, name in enumerate(channels):
        rest = [j for j in range(k) if j != i]
        w = _positive_lasso(cov[np.ix_(rest, rest)], cov[rest, i], alpha)
        out += [(name, channels[j], float(x)) for j, x in zip(rest, w)]
    return pixels.sparkSession.createDataFrame(out, "target string, channel string, weight double")


def fit_closed(pixels: DataFrame, pairs: DataFrame, roi: Box | None = None, on=()) -> DataFrame:
    """Weight in [0, 1] of each listed ``(target, channel)`` pair: sum(s*n) / sum(n*n), clipped.

    The terms of the supervised objective do not interact, so each weight is one
    ratio of sums.
    """
    p = in_roi(pixels, roi)
    noise = p.join(pairs, "channel").select(*on, "target", "channel", "y", "x", F.col("value").alias("_n"))
    source = p.select(*on, F.col("channel").alias("target"), "y", "x", F.col("value").alias("_s"))
    sums = noise.join(source, [*on, "target", "y", "x"], "left").groupBy("target", "channel").agg(
        F.sum(F.coalesce("_s", F.lit(0)) * F.col("_n")).alias("_sn"), F.sum(F.col("_n") * F.col("_n")).alias("_nn")
    )
    ratio = F.when(F.col("_nn") > 0, F.col("_sn") / F.col("_nn")).otherwise(F.lit(1.0))
    return sums.select("target", "channel", F.greatest(F.least(ratio, F.lit(1.0)), F.lit(0.0)).alias("weight"))


def top_noise_channels(weights: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` largest positive weights of each target."""
    return top_per_key(weights.where("weight > 0"), ["target"], [F.col("weight").desc(), F.col("channel").desc()], k)


def noise_columns(weights: DataFrame, k: int = 3) -> DataFrame:
    """Wide script columns ``channel 1..k``, padded with nulls; one row per target."""
    top = top_noise_channels(weights, k).groupBy("target").pivot("rank", list(range(1, k + 1))).agg(F.first("channel"))
    named = top.select("target", *(F.col(str(i)).alias(f"channel {i}") for i in range(1, k + 1)))
    return weights.select("target").distinct().join(named, "target", "left")


def apply(pixels: DataFrame, weights: DataFrame, dtype: str = "uint16", on=()) -> DataFrame:
    """Subtract weighted channels, clamp at 0, round back to the pixel type.

    Every target is a signed sum of channels at one pixel, so one join with the
    small weight table and one aggregate do it.
    """
    own = pixels.select("channel").distinct().select(F.col("channel").alias("target"), "channel", F.lit(1.0).alias("coef"))
    coef = own.unionByName(weights.select("target", "channel", (-F.col("weight")).alias("coef")))
    # pixels are dealt by place before they are repeated for their targets, so the sums meet there; weights are one row a pair of channels
    dealt = pixels.repartition(*on, "y", "x").join(F.broadcast(coef), "channel")
    mixed = dealt.groupBy(*on, "target", "y", "x").agg(F.sum(F.col("value") * F.col("coef")).alias("v"))
    return mixed.select(*on, F.col("target").alias("channel"), "y", "x", to_dtype(F.col("v"), dtype).alias("value"))


def restretch_low_contrast(pixels: DataFrame, dtype: str = "uint16", fraction: float = 0.05) -> DataFrame:
    """Stretch images whose 1-99 percentile range is below ``fraction`` of the type's range.

    They are stretched from 0 to their 99.99999 percentile; others stay.
    """
    top = DTYPE_MAX[dtype]
    s = image_stats(pixels, ["channel"], (1, 99, 99.99999)).select(
        "channel", ((F.col("p1") - F.col("p0")) / top < fraction).alias("_low"), F.col("p2").alias("_hi")
    )
    value = F.when(F.col("_low"), stretch(F.col("value"), F.lit(0), F.col("_hi"), top)).otherwise(F.col("value"))
    return pixels.join(s, "channel").withColumn("value", value).drop("_low", "_hi")


def normalized(value: Column, dtype: str) -> Column:
    return value / DTYPE_MAX[dtype]
