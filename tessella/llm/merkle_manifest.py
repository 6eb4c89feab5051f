"""Merkle manifest of a data set by time-forward processing.

Rows are leaves, ordered within their group; every ``FANOUT`` consecutive nodes become the hash of
their digests until one node, the group's root, remains. Group roots form a tree of the same kind.

A tree is swept in blocks of ``FANOUT ** HEIGHT`` consecutive nodes. Spark's shuffle and sort by
(group, block, position) is the external queue that brings messages to the block that waits for them.
Inside a block a node's label is (its last position, its level), so children precede their parents:

* Forward, a priority queue ordered by label delivers child digests to parents. The top nodes of all
  blocks are the leaves of the next, ``FANOUT ** HEIGHT`` times shorter sweep.
* Backward, in falling order of labels, each node passes its proof suffix (the siblings from its own
  level to the root) on to its children, with their siblings in front. The suffix of a block's top comes
  from the sweep above as the first row of the block.

A task holds one block, of fixed size, so a group with a third of all rows is many tasks.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import numbered
from ..runtime import stage

FANOUT, HEIGHT = 3, 7
BLOCK = FANOUT**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SUFFIX = "array<struct<l:string,r:string>>"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """SHA-256 over the fields, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and its value."""
    text = lambda c: c.cast("string")
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in fields)), 256)


def forward(digests: list[str], levels: int) -> list[list[str]]:
    """Digests of the nodes of each level from 0 to ``levels`` over a block's nodes, by a queue of messages to parents."""
    out, queue = [list(digests), *([] for _ in range(levels))], []

    def send(level: int, index: int, digest: str) -> None:
        if level < levels:
            parent = index // FANOUT
            # label of the receiver: the last position below it, then its level
            heapq.heappush(queue, ((parent + 1) * FANOUT ** (level + 1) - 1, level + 1, parent, index, digest))

    def deliver(now: float) -> None:
        while queue and queue[0][0] <= now:
            _, level, parent, _, text = heapq.heappop(queue)
            while queue and queue[0][1:3] == (level, parent):
                text += heapq.heappop(queue)[4]
            out[level].append(_hash(text))
            send(level, parent, out[level][parent])

    for at, digest in enumerate(digests):
        send(0, at, digest)
        deliver(at)
    deliver(float("inf"))
    return out


def backward(nodes: list[list[str]], suffix: tuple) -> list[tuple]:
    """Each leaf's proof suffix, as linked ``(left, right, rest)``, from that of the block's single top node."""
    top = len(nodes) - 1
    out: list = [None] * len(nodes[0])
    queue = [(-(FANOUT**top - 1), -top, 0, suffix)]
    while queue:
        _, level, index, rest = heapq.heappop(queue)
        level = -level
        if level == 0:
            out[index] = rest
            continue
        first, below = index * FANOUT, nodes[level - 1]
        run = below[first : first + FANOUT]
        for i in range(len(run)):
            child = first + i
            mine = ("".join(run[:i]), "".join(run[i + 1 :]), rest)
            heapq.heappush(queue, (-((child + 1) * FANOUT ** (level - 1) - 1), 1 - level, child, mine))
    return out


def _height(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _blocks(batches) -> Iterator[tuple[tuple, list]]:
    """Runs of rows ``(g, block, ...)`` of sorted partitions, one block at a time."""
    rows = (row for batch in batches for row in zip(*(batch[c] for c in batch.columns)))
    for name, found in groupby(rows, key=lambda r: r[:2]):
        yield name, list(found)


def _up(batches) -> Iterator[pd.DataFrame]:
    columns = ["g", "block", "top", "root", "height"]
    out = []
    for (g, block), rows in _blocks(batches):
        nodes = forward([r[2] for r in rows], HEIGHT)
        height = _height(len(rows))
        out.append((g, block, nodes[HEIGHT][0], nodes[height][0], height))
        if len(out) == 1000:
            yield pd.DataFrame(out, columns=columns)
            out = []
    yield pd.DataFrame(out, columns=columns)


def _chain(suffix: list) -> tuple:
    rest: tuple = ()
    for step in reversed(suffix):
        rest = (step["l"], step["r"], rest)
    return rest


def _steps(chain: tuple) -> Iterator[tuple[str, str]]:
    while chain:
        yield chain[0], chain[1]
        chain = chain[2]


def _down(batches, finish) -> Iterator[pd.DataFrame]:
    """Rows of blocks, whose first row is the block's own (levels, suffix, root), through ``finish``."""
    for _, rows in _blocks(batches):
        head, rows = rows[0], rows[1:]
        suffixes = backward(forward([r[2] for r in rows], int(head[6])), _chain(head[7]))
        yield finish(rows, suffixes, head)


def _passed(rows, suffixes, head) -> pd.DataFrame:
    return pd.DataFrame({
        "g": head[0], "pos": [r[3] for r in rows], "suffix": [[{"l": a, "r": b} for a, b in _steps(s)] for s in suffixes], "root": head[8],
    })


def _proved(rows, suffixes, head) -> pd.DataFrame:
    out = []
    for (_, _, digest, _, key, seen, *_), chain in zip(rows, suffixes):
        proof, folded = hashlib.sha256(), seen
        for a, b in _steps(chain):
            proof.update((a + b).encode())
            folded = _hash(a + folded + b)
        out.append((key, digest, head[9], head[8], proof.hexdigest(), folded, folded == head[8], len(list(_steps(chain)))))
    return pd.DataFrame(out, columns=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof_levels"])


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", *order)


def _with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))


def tops(nodes: DataFrame) -> DataFrame:
    """Written ``(g, block, levels, suffix, root)``: how many levels each block of ``nodes (g, pos, digest)`` has, and its top's proof."""
    rows = _dealt(_with_block(nodes).select("g", "block", "digest", "pos"), "pos")
    up = stage(rows.mapInPandas(_up, "g string, block long, top string, root string, height int"), "tops")
    lone = up.groupBy("g").agg(F.count("*").alias("n")).where("n = 1").select("g")
    alone = up.join(lone, "g", "left_semi").select(
        "g", "block", F.col("height").alias("levels"), F.array().cast(_SUFFIX).alias("suffix"), "root"
    )
    many = stage(up.join(lone, "g", "left_anti").select("g", F.col("block").alias("pos"), F.col("top").alias("digest")), "nodes")
    if many.isEmpty():
        return alone
    above = proofs(many).select("g", F.col("pos").alias("block"), F.lit(HEIGHT).alias("levels"), "suffix", "root")
    return stage(alone.unionByName(above), "proofs")


def _swept(nodes: DataFrame, heads: DataFrame, finish, schema: str) -> DataFrame:
    """Backward sweep over ``nodes (g, block, digest, pos, key, seen)`` below ``heads (g, block, levels, suffix, root, subroot)``."""
    head = heads.select(
        "g", "block", F.lit("").alias("digest"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("key"),
        F.lit(None).cast("string").alias("seen"), "levels", "suffix", "root", "subroot",
    )
    empty = {"levels": "int", "suffix": _SUFFIX, "root": "string", "subroot": "string"}
    body = nodes.select("g", "block", "digest", "pos", "key", "seen", *(F.lit(None).cast(t).alias(c) for c, t in empty.items()))
    return _dealt(head.unionByName(body), "pos").mapInPandas(partial(_down, finish=finish), schema)


def proofs(nodes: DataFrame) -> DataFrame:
    """``(g, pos, suffix, root)`` for ``nodes (g, pos, digest)``: the siblings of each node, level by level, and its group's root."""
    null = F.lit(None).cast("string")
    rows = _with_block(nodes).withColumns({"key": null, "seen": null})
    return _swept(rows, tops(nodes).withColumn("subroot", null), _passed, f"g string, pos long, suffix {_SUFFIX}, root string")


def manifest(docs: DataFrame, replica: dict[str, Column] | None = None, fields=FIELDS, key: str = "doc_id", group: str = "source") -> DataFrame:
    """``(key, leaf, subroot, root, proof_sha256, folded_root, verified, proof_levels)`` for each row of ``docs``.

    ``replica`` gives fields as a replica holds them; its leaf is folded with the original siblings, and
    ``verified`` says whether that gives the root. Leaves of a group go by key, null first, rows of equal
    key by their digest (equal rows are leaves each); groups by name in UTF-8 order, null first. Nulls are
    fields like any other, empty and long texts are hashed whole, an empty table gives no rows, other
    columns are not read.
    """
    replica = replica or {}
    kind = dict(docs.dtypes)[key]
    # a name without nulls, in the same order
    name = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    rows = docs.select(
        name.alias("g"), F.col(key).alias("key"), leaf([F.col(c) for c in fields]).alias("digest"),
        leaf([replica.get(c, F.col(c)) for c in fields]).alias("seen"),
    )
    ranked = numbered(rows, [F.col("key").asc_nulls_first(), F.col("digest"), F.col("seen")], "n", ["g"])
    leaves = ranked.select("g", (F.col("n") - 1).alias("pos"), "digest", F.col("key").cast("string").alias("key"), "seen")
    leaves = stage(leaves, "leaves")
    blocks = tops(leaves)
    groups = blocks.groupBy("g").agg(F.first("root").alias("digest"))
    groups = stage(numbered(groups, [F.col("g")], "n").select("g", (F.col("n") - 1).alias("pos"), "digest"), "groups")
    above = proofs(groups.select(F.lit("").alias("g"), "pos", "digest")).select("pos", F.col("suffix").alias("more"), F.col("root").alias("all"))
    above = groups.join(above, "pos").select("g", "more", "all")
    heads = blocks.join(above, "g").select(
        "g", "block", "levels", F.concat("suffix", "more").alias("suffix"), F.col("all").alias("root"), F.col("root").alias("subroot")
    )
    schema = (
        "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof_levels long"
    )
    out = _swept(_with_block(leaves), heads, _proved, schema)
    return out.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)
