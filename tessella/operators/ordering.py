"""Ranks and running aggregates that never put one key into one task.

A window function sends a whole key to one task. Here the rows are range
partitioned by (keys, order) and written once with their range number, so the
ranges stay fixed however often the table is read. A running value is then the
sum of the earlier ranges of its key (a table with one row per key and range)
plus a window inside the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import stage

BUCKET = "_range"


def range_bucketed(df: DataFrame, keys, order) -> DataFrame:
    """Stage ``df`` with a ``_range`` number that follows (keys, order).

    The input is written first: finding the range bounds reads it once more, and
    that second read should be a narrow file scan, not the plan that made the rows.
    """
    spread = stage(df, "rows").repartitionByRange(*[F.col(k) for k in keys], *order)
    return stage(spread.withColumn(BUCKET, F.spark_partition_id()), "ranges")


def _earlier(staged: DataFrame, keys, aggregates: dict[str, Column], combine, backwards: bool) -> DataFrame:
    step = F.col(BUCKET).desc() if backwards else F.col(BUCKET).asc()
    before = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    totals = staged.groupBy(*keys, BUCKET).agg(*(e.alias(n) for n, e in aggregates.items()))
    return totals.select(*keys, BUCKET, *(combine(n).over(before).alias(f"_before_{n}") for n in aggregates))


def running_sums(staged: DataFrame, keys, order, sums: dict[str, str]) -> DataFrame:
    """Add running sums (output name -> input column) over the staged order."""
    keys = list(keys)
    offsets = _earlier(staged, keys, {n: F.sum(c) for n, c in sums.items()}, F.sum, False)
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = staged.join(offsets, [*keys, BUCKET])
    return joined.select(
        *staged.columns,
        *(
            (F.sum(c).over(inside) + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n)
            for n, c in sums.items()
        ),
    )


def running_max_from_end(staged: DataFrame, keys, order, column: str, name: str) -> DataFrame:
    """Largest value at or after each row in the staged order."""
    keys = list(keys)
    offsets = _earlier(staged, keys, {name: F.max(column)}, F.max, True)
    place = F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy(*order))
    # from the end, so that a row adds one value; a frame up to the end is read again for every row
    inside = Window.partitionBy(*keys, BUCKET).orderBy(F.col("_place").desc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = staged.join(offsets, [*keys, BUCKET]).withColumn("_place", place)
    return joined.select(
        *staged.columns, F.greatest(F.max(column).over(inside), F.col(f"_before_{name}")).alias(name)
    )


def numbered(df: DataFrame, order, name: str = "ID", keys=()) -> DataFrame:
    """Row numbers 1..N in the given total order, per key if keys are given."""
    staged = range_bucketed(df.withColumn("_one", F.lit(1).cast("long")), keys, order)
    return running_sums(staged, keys, order, {name: "_one"}).drop("_one", BUCKET)


def dense_relabel(df: DataFrame, column: str, name: str) -> DataFrame:
    """Replace sparse labels by 1..K in ascending order."""
    ids = numbered(df.select(column).distinct(), [F.col(column)], name)
    return df.join(ids, column)


def batches(df: DataFrame, order, size: int, name: str = "batch") -> DataFrame:
    """Consecutive batches of ``size`` rows, numbered from 0."""
    return (
        numbered(df, order, "_rn")
        .withColumn(name, F.floor((F.col("_rn") - 1) / size))
        .drop("_rn")
    )


def contiguous_shards(df: DataFrame, order, shards: int, name: str = "shard") -> DataFrame:
    """Split the ordered rows into ``shards`` contiguous ranges of near-equal size.

    The first ``N mod shards`` shards hold one row more, like ``ntile``.
    """
    rows = numbered(df, order, "_rn")
    total = df.agg(F.count("*").alias("n")).scalar()
    base, extra = F.floor(total / shards), total % shards
    cut = extra * (base + 1)
    at = F.col("_rn") - 1
    shard = F.when(at < cut, F.floor(at / (base + 1))).otherwise(extra + F.floor((at - cut) / base))
    return rows.withColumn(name, shard + 1).drop("_rn")


def top_per_key(df: DataFrame, keys, order, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key.

    Spark limits each key to ``k`` rows before the shuffle, so hot keys stay small.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def top_fraction(df: DataFrame, keys, order, p: float) -> DataFrame:
    """The best ``p`` of each key, at least one row."""
    keys = list(keys)
    ranked = numbered(df, order, "_rn", keys)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")) if keys else None
    if sizes is not None:
        ranked = ranked.join(sizes, keys)
    else:
        ranked = ranked.withColumn("_n", df.agg(F.count("*").alias("n")).scalar())
    keep = F.greatest(F.lit(1), F.floor(F.col("_n") * p))
    return ranked.where(F.col("_rn") <= keep).drop("_rn", "_n")


def sort_by_field(df: DataFrame, field: str, order: str = "desc", tie: str | None = None) -> DataFrame:
    """Sort by any field; an unknown order is an error."""
    if order not in ("asc", "desc"):
        raise ValueError(f"order must be 'asc' or 'desc', not {order!r}")
    if field not in df.columns:
        raise ValueError(f"no field {field!r}")
    first = F.col(field).asc() if order == "asc" else F.col(field).desc()
    return df.orderBy(first, *([F.col(tie)] if tie else []))


def hash_order(key: str, seed: int = 0) -> list[Column]:
    """A random order that depends only on ``key`` and ``seed``, on any engine: MD5 of ``key-seed``, then the key."""
    return [F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)]


def shuffled(df: DataFrame, key: str, seed: int = 0, position: str | None = None) -> DataFrame:
    """The rows in hash order; ``position`` names a column with their numbers from 1."""
    return df.orderBy(*hash_order(key, seed)) if position is None else numbered(df, hash_order(key, seed), position)
