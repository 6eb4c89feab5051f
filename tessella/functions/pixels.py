"""Pixel and label expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UM_PER_PIXEL = 0.325
DTYPE_MAX = {"uint8": 255, "uint16": 65535}


def area_um2(pixels: Column, um_per_pixel: float = UM_PER_PIXEL) -> Column:
    return pixels * (um_per_pixel**2)


def density(count: Column, pixels: Column, per_um2: float = 10.0**6, um_per_pixel: float = UM_PER_PIXEL) -> Column:
    """Objects per ``per_um2`` square micrometres."""
    return count * per_um2 / area_um2(pixels, um_per_pixel)


def unit_range(value: Column, dtype: Column) -> Column:
    """Pixel value as a fraction of its type's largest value."""
    expr = F.lit(None).cast("double")
    for name, top in DTYPE_MAX.items():
        expr = F.when(dtype == name, value / top).otherwise(expr)
    return expr


def stretch(value: Column, low: Column, high: Column, top: int) -> Column:
    """Linear stretch of [low, high] to [0, top], clamped and truncated."""
    clamped = F.greatest(F.least(value, high), low)
    return F.when(high > low, F.floor((clamped - low) * float(top) / (high - low))).otherwise(F.lit(0)).cast("long")


def levels(text: Column, dtype: str) -> tuple[Column, Column]:
    """Low and high cut from ``'lo,hi'``; 16-bit images use 8-bit levels times 257."""
    factor = 257 if dtype == "uint16" else 1
    parts = F.split(text, ",")
    return parts[0].cast("long") * factor, parts[1].cast("long") * factor


def rescale(df: DataFrame, keys, dtype: str, value: str = "value") -> DataFrame:
    """Stretch each image from its own minimum and maximum to the full range."""
    keys = list(keys)
    top = DTYPE_MAX[dtype]
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    if keys:
        df = df.join(ends, keys)
        lo, hi = F.col("_lo"), F.col("_hi")
    else:
        lo, hi = ends.select("_lo").scalar(), ends.select("_hi").scalar()
    return df.withColumn(value, stretch(F.col(value), lo, hi, top)).drop("_lo", "_hi")


def standardize(df: DataFrame, position, value: str = "value") -> DataFrame:
    """Subtract the mean and divide by the deviation of each pixel position."""
    position = list(position)
    stats = pixel_mean_std(df, position, value)
    out = df.join(stats, position)
    return out.withColumn(
        value, F.when(F.col("std") > 0, (F.col(value) - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0))
    ).drop("mean", "std")


def pixel_mean_std(df: DataFrame, position, value: str = "value") -> DataFrame:
    return df.groupBy(*position).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def rule_token(token: Column) -> Column:
    """``+`` is 1, ``-`` is 0, anything else does not matter (null)."""
    return F.when(F.trim(token) == "+", 1).when(F.trim(token) == "-", 0)


def one_hot(class_id: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == class_id).cast("int"))


def k_hot(class_ids: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(class_ids, i).cast("int"))


def content_key(data: Column) -> Column:
    return F.sha2(data, 256)
