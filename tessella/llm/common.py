"""Word splitting and small helpers that the operators of this package share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, empty for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII texts take the fast path; the result is the same."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def spaced_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text without nulls."""
    return F.array_remove(F.split(text, SPACE), "")


def alnum_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a lower-cased text without nulls."""
    return F.array_remove(F.split(text, NOT_ALNUM), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often a lambda inside uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pieces(batches, column: str, chars: int = 2_000_000):
    """Pandas batches cut so that the texts of a piece hold about ``chars`` characters, or are one text."""
    for batch in batches:
        for _, piece in batch.groupby(batch[column].str.len().cumsum() // chars, sort=False):
            yield piece


#: Bits of a bitmap of hash slots, 8 MB whatever the data. Marks are upper bounds: the exact step comes after.
SLOTS = 1 << 26


def bitmap(slots: DataFrame) -> np.ndarray:
    """Bytes of the bitmap of a column ``slot`` of numbers below ``SLOTS``; of fixed size, so it may come to the driver."""
    at = F.col("slot") + 1
    parts = slots.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m"))
    bits = np.zeros(SLOTS // 8, np.uint8)
    for r in parts.toLocalIterator():
        bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return bits


def marked(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else as it is, to be joined by a shuffle.

    ``df`` should be a written table: its rows are counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
