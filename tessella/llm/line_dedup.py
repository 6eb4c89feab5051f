"""Line de-duplication with content-defined chunks of lines.

A rolling hash over the hashes of the last ``WINDOW`` lines puts a chunk boundary after a line, so a
passage is cut at the same lines wherever it stands. A line of ``long_words`` words or more is a
chunk of its own. The edges of a passage share chunks with its surroundings, so spans from each line
with text to the next one are looked up besides the chunks: a repeated run of two lines or more is
made of repeated spans, wherever its boundaries fall. Chunks of two lines or more, long lines and
spans that occur again in the collection are removed but for their first occurrence, by (key, place).
Equal hashes only nominate; the bytes decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import stage
from .common import SLOTS, bitmap, marked, pieces, text_of

WINDOW, DIVISOR, LONG_WORDS = 2, 2, 50
BLANK = " \t\n\r\x0b\x0c"


def chunks(text: str, long_words: int = LONG_WORDS) -> list[tuple[int, int]]:
    """Line ranges ``[from, to)`` that cover ``text.split("\\n")``."""
    lines = text.split("\n")
    hashes = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) for x in lines]
    out, start = [], 0
    for i, line in enumerate(lines):
        long = len(line) > 2 * (long_words - 1) and len(line.split()) >= long_words
        if long and start < i:
            out.append((start, i))
            start = i
        rolling = 0
        for h in hashes[max(0, i - WINDOW + 1) : i + 1]:
            rolling = (rolling * 1_000_003 + h) & 0xFFFFFFFFFFFFFFFF
        if long or (rolling >> 32) % DIVISOR == 0 or i == len(lines) - 1:
            out.append((start, i + 1))
            start = i + 1
    return out


def candidates(text: str, long_words: int):
    """``(number, chunk)`` of the chunks that may be removed: two lines or more with a word, or a long line."""
    lines = text.split("\n")
    for number, (a, b) in enumerate(chunks(text, long_words)):
        chunk = "\n".join(lines[a:b])
        if (b - a > 1 and chunk.strip(BLANK)) or len(chunk.split()) >= long_words:
            yield number, chunk


def units(text: str, long_words: int):
    """``(from, to, lines)`` of what may be removed: the candidate chunks, and the spans from each line with text to the next."""
    lines, ranges = text.split("\n"), chunks(text, long_words)
    found = {ranges[number]: chunk for number, chunk in candidates(text, long_words)}
    last = None
    for i, line in enumerate(lines):
        if line.strip(BLANK):
            if last is not None and (last, i + 1) not in found:
                found[last, i + 1] = "\n".join(lines[last : i + 1])
            last = i
    for (a, b), chunk in found.items():
        yield a, b, chunk


def _hash(chunk: str) -> int:
    return xxhash.xxh3_64_intdigest(chunk.encode("utf-8", "replace")) - (1 << 63)


def _hashed(batches, long_words: int):
    for batch in pieces(batches, "t"):
        yield pd.DataFrame({"h": np.array([_hash(c) for t in batch["t"] for _, _, c in units(t, long_words)], dtype=np.int64)})


def _cut(batches, long_words: int, shared):
    bits = shared.value
    for batch in pieces(batches, "t"):
        rows = [(k, i, a, b, c) for k, i, t in zip(batch["key"], batch["id"], batch["t"]) for a, b, c in units(t, long_words)]
        rows = pd.DataFrame(rows, columns=["key", "id", "a", "b", "chunk"])
        yield rows[marked(bits, np.array([_hash(c) % SLOTS for c in rows["chunk"]], dtype=np.int64))]


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the line ranges of ``_gone`` out of ``_text``; all other columns go through as they are."""
    for batch in batches:
        texts, removed = batch.column("_text").to_pylist(), []
        for at, gone in enumerate(batch.column("_gone").to_pylist()):
            removed.append(0)
            if gone:
                gone = {i for r in gone for i in range(r["a"], r["b"])}
                texts[at] = "\n".join(x for i, x in enumerate(texts[at].split("\n")) if i not in gone)
                removed[-1] = len(gone)
        names = [n for n in batch.schema.names if n not in ("_text", "_gone")]
        columns = [*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array(removed, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*names, "_text", "_removed"])


def repeated(docs: DataFrame, long_words: int = LONG_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Written ``(key, id, gone)``: line ranges ``[a, b)`` to remove from the document of that key and text hash."""
    rows = docs.select(F.col(key).cast("long").cast("string").alias("key"), F.xxhash64(text).alias("id"), text_of(text).alias("t"))
    hashes = rows.mapInPandas(partial(_hashed, long_words=long_words), "h long")
    again = hashes.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select(F.pmod("h", F.lit(SLOTS)).alias("slot"))
    # chunks of marked slots are cut out of the texts in a second scan: no text is shuffled to find them
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(again))
    cut = stage(rows.mapInPandas(partial(_cut, long_words=long_words, shared=shared), "key string, id long, a int, b int, chunk string"), "cut")
    doc = (F.col("key").cast("long").alias("key"), "id")
    first = cut.groupBy("chunk").agg(F.min(F.struct(*doc, "a", "b")).alias("first"), F.count("*").alias("m")).where("m > 1")
    # in the document of its first occurrence a repeat starts after that has ended
    same = F.struct(*doc).eqNullSafe(F.struct("first.key", "first.id"))
    gone = cut.join(first, "chunk").where(~same | (F.col("a") >= F.col("first.b")))
    return stage(gone.groupBy("key", "id").agg(F.collect_set(F.struct("a", "b")).alias("gone")), "gone")


def dedup(docs: DataFrame, long_words: int = LONG_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with repeated chunks and runs of lines cut from ``text``, and a column ``lines_removed``.

    Keys are integers or null; a null key comes first in the order. Rows that repeat key and text are
    one document: they lose the same chunks. Null texts stay null, empty ones empty. Other columns
    stay, whatever they are called, but for ``lines_removed``, which is replaced.
    """
    gone = repeated(docs, long_words, text, key)
    names = [c for c in docs.columns if c != "lines_removed"]
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)))
    k, t = f"c{names.index(key)}", f"c{names.index(text)}"
    rows = rows.withColumn("_key", F.col(k).cast("long").cast("string")).withColumn("_id", F.xxhash64(t))
    # the same join at every size: a list of removals grows with the data and is never broadcast
    joined = rows.hint("merge").join(gone, rows["_key"].eqNullSafe(gone["key"]) & (rows["_id"] == gone["id"]), "left")
    kept = [c for c in rows.columns if c not in ("_key", "_id", t)]
    joined = joined.select(*kept, F.col(t).alias("_text"), F.col("gone").alias("_gone"))
    schema = joined.drop("_gone").schema.add("_removed", "long")
    out = joined.mapInArrow(_without, schema)
    order = [F.col("_text" if f"c{i}" == t else f"c{i}").alias(c) for i, c in enumerate(names)]
    return out.select(*order, F.col("_removed").alias("lines_removed"))
