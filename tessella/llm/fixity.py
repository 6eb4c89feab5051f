"""Merkle fixity audit of replicated archives of WARC records.

A leaf is the SHA-256 of one record. A node of level 1 hashes, in order, the offsets, lengths and
digests of the records that begin in one offset range of ``span`` bytes; a node of a higher level
hashes ``fanout`` ranges below it. Two replicas whose roots are equal are equal. Otherwise the audit goes
down level by level and reads only the children of nodes that differ, to the damaged records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import range_bucketed, running_sums
from ..runtime import stage
from .common import text_of

SPAN, FANOUT = 1 << 16, 16


def record_of(uri: Column, payload: Column) -> Column:
    """Bytes of a WARC resource record. Null values count as empty."""
    body = text_of(payload)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), text_of(uri), F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def archive(rows: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """Written ``(key, offset, data)``: one record for each row, laid end to end by (key, digest of the record).

    Rows that repeat give equal records one after the other; a null key comes first.
    """
    data = rows.select(F.col(key).alias("key"), record_of(F.col(uri), F.col(payload)).alias("data"))
    data = data.withColumn("digest", F.sha2("data", 256))
    data = data.withColumn("name", F.concat_ws(":", F.col("key").cast("string"), "digest"))
    # places come from lengths alone; copies are counted before they meet, so one record with very many copies is one row
    sizes = data.groupBy("name").agg(
        F.min("key").alias("key"), F.min("digest").alias("digest"), F.count("*").alias("copies"), F.max(F.octet_length("data")).cast("long").alias("length")
    )
    order = [F.col("key"), F.col("digest")]
    narrow = range_bucketed(sizes.withColumn("size", F.col("length") * F.col("copies")), [], order)
    ends = running_sums(narrow, [], order, {"end": "size"}).select("name", "copies", "length", (F.col("end") - F.col("size")).alias("start"))
    # grouped and joined by one name, so the records are shuffled once
    each = data.groupBy("name").agg(F.any_value("key").alias("key"), F.any_value("data").alias("data"))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    laid = each.hint("merge").join(ends, "name").select("key", "start", "data", "length", copy.alias("i"))
    return stage(laid.select("key", (F.col("start") + F.col("i") * F.col("length")).alias("offset"), "data"), "archive")


def leaves(records: DataFrame) -> DataFrame:
    """Written ``(key, offset, length, digest)`` of records ``(key, offset, data)``."""
    length = F.octet_length("data").cast("long").alias("length")
    return stage(records.select("key", "offset", length, F.sha2("data", 256).alias("digest")), "leaves")


def _hash(parts: Column) -> Column:
    """SHA-256 over the sorted ``(place, text)`` structs."""
    return F.sha2(F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat_ws(":", p["at"].cast("string"), p["x"])), "\n").cast("binary"), 256)


def tree(leaf: DataFrame, levels: int, span: int = SPAN, fanout: int = FANOUT) -> list[DataFrame]:
    """Nodes ``(node, hash)`` of each level, ranges of ``span`` bytes first; each level is written once."""
    x = F.concat_ws(":", F.col("length").cast("string"), F.col("digest"))
    down = leaf.select(F.floor(F.col("offset") / span).alias("node"), F.col("offset").alias("at"), x.alias("x"))
    out = []
    for _ in range(levels):
        nodes = stage(down.groupBy("node").agg(_hash(F.collect_list(F.struct("at", "x"))).alias("hash")), "nodes")
        out.append(nodes)
        down = nodes.select(F.floor(F.col("node") / fanout).alias("node"), F.col("node").alias("at"), F.col("hash").alias("x"))
    return out


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select("node", F.col("hash").alias("other"))
    return a.join(b, "node", "full_outer").where(~F.col("hash").eqNullSafe(F.col("other"))).select("node")


def audit(a: DataFrame, b: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """Damaged records ``(key, offset, length, status, root_a, root_b)`` between two replicas ``(key, offset, data)``.

    ``status`` is ``changed``, or ``missing`` or ``extra`` where only the first or only the second replica has a
    record at that offset. Records of equal offset are compared as a set. Equal or empty replicas give no rows.
    """
    a, b = leaves(a), leaves(b)
    top = max([d.agg(F.coalesce(F.max("offset"), F.lit(0)).alias("m")).first()["m"] for d in (a, b)]) // span
    levels = 1
    while top:
        top //= fanout
        levels += 1
    left, right = tree(a, levels, span, fanout), tree(b, levels, span, fanout)
    bad = stage(_differing(left[-1], right[-1]), "differing")
    for x, y in zip(left[-2::-1], right[-2::-1]):
        if bad.isEmpty():
            break
        parents = bad.select(F.col("node").alias("_parent"))
        below = lambda d: d.join(parents, F.floor(d["node"] / fanout) == F.col("_parent"), "left_semi")
        bad = stage(_differing(below(x), below(y)), "differing")
    inside = lambda d: d.join(bad, F.floor(d["offset"] / span) == bad["node"], "left_semi")
    x, y = stage(inside(a), "suspect"), stage(inside(b), "suspect")
    only = lambda p, q, first: p.join(q.select("offset", "digest"), ["offset", "digest"], "left_anti").withColumn("in_a", F.lit(first))
    only_a, only_b = only(x, y, True), only(y, x, False)
    status = F.when(F.count_if("in_a") == 0, "extra").when(F.count_if(~F.col("in_a")) == 0, "missing").otherwise("changed")
    first = F.min_by(F.struct("key", "length"), F.struct(~F.col("in_a"), "key", "length")).alias("r")
    found = only_a.unionByName(only_b).groupBy("offset").agg(first, status.alias("status"))
    root_a, root_b = ((d[-1].first() or {"hash": None})["hash"] for d in (left, right))
    return found.select(
        "r.key", "offset", "r.length", "status", F.lit(root_a).cast("string").alias("root_a"), F.lit(root_b).cast("string").alias("root_b")
    )
