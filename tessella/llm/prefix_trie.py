"""Prefix trie of conversations as a z-fast trie kept in Spark tables.

A conversation is a string whose letters are turns. The fingerprint of its first ``d`` turns is a pair of
polynomial hashes, ``sum(h_i * B ** i) mod p``, so it is a running sum and no task needs a whole
conversation. The compacted trie is a table of explicit nodes (the ends of conversations and the places
where they part); the edge above a node covers the depths ``(a, e]`` of its owner, and the node is
found by its handle: the owner's fingerprint at the two-fattest depth of ``(a, e]``, the one number in it that the
highest power of two divides.

Distinct conversations are inserted in batches:

1. **Exit nodes** by fat binary search: each conversation keeps an interval of depths, asks for the handle at
   its two-fattest number, and goes on below the node that is found, or above the number. That is one join
   for each binary digit of the greatest depth. The child edge at the last node, and the fingerprints
   that agree along that edge, give the depth at which the conversation leaves the trie.
2. Edges are split where conversations leave them; what lies below is new, and its nodes with an end or with
   two children become explicit.

Members, leaves and words are summed over subtrees by pointer doubling on the compacted trie. At last the edges
are expanded into one row a depth. Copies are merged before insertion, and every aggregate combines before its shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ordering import numbered, range_bucketed, running_sums
from ..runtime import stage
from .common import EMPTY_SHA, spaced_words, text_of

#: Moduli and bases of the two hashes of a prefix (fixed values, below 2^61).
HASHES = ((2305843009213693951, 1160241397012584583), (2305843009213693921, 1785462183649872467))
ROOT = "0" * 32
BATCHES = 2
#: Depths of an edge, and members of a node, that one row of an intermediate table may hold.
CHUNK = 4096


def _powered(batches) -> Iterator[pd.DataFrame]:
    """Each turn's summand of the two prefix hashes."""
    for b in batches:
        for n, (p, base) in enumerate(HASHES, 1):
            b[f"h{n}"] = [h * pow(base, d, p) % p for h, d in zip(b[f"h{n}"].tolist(), b["d"].tolist())]
        yield b


def ordered_turns(turns: DataFrame, key: str) -> DataFrame:
    """``(c, n, h1, h2, w)``: each turn's number from 1, fingerprint and words, in the order of ``turn``, null first."""
    role, text = text_of("role"), text_of("text")
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    rows = turns.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("c"), F.col("turn").alias("turn"), digest.alias("digest"), F.size(spaced_words(text)).cast("long").alias("w")
    )
    rows = rows.select("c", "turn", "w", part(1).alias("h1"), part(16).alias("h2"))
    return stage(numbered(rows, [F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")], "n", ["c"]), "turns")


def head_turns(c: Column) -> Column:
    """How many turns a conversation takes from the first of its group of twenty."""
    return F.crc32(c.cast("string").cast("binary")) % 4


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(c)`` and ``(c, d, h1, h2, w)``: every conversation, its first turns replaced by those of its group's first one."""
    convs = turns.groupBy("c").agg(F.count("*").alias("own")).select("c", "own", head_turns(F.col("c")).alias("h"), (F.col("c") - F.col("c") % 20).alias("b"))
    sizes = convs.select(F.col("c").alias("b"), F.col("own").alias("there"))
    convs = stage(convs.join(sizes, "b", "left").withColumn("got", F.least("h", F.coalesce("there", F.lit(0)))), "conversations")
    heads = turns.where((F.col("c") % 20 == 0) & (F.col("n") <= 3)).withColumnRenamed("c", "b")
    taken = convs.join(heads, "b").where(F.col("n") <= F.col("h")).select("c", F.col("n").alias("d"), "h1", "h2", "w")
    left = turns.where(F.col("n") > head_turns(F.col("c"))).join(convs.select("c", "h", "got"), "c")
    left = left.select("c", (F.col("n") - F.col("h") + F.col("got")).alias("d"), "h1", "h2", "w")
    return convs.select("c"), stage(taken.unionByName(left), "rebuilt")


def prefixes(rows: DataFrame) -> DataFrame:
    """Written ``(c, d, f, pf, w, cw)``: fingerprints of each prefix and of the one before, words of the last turn and of all."""
    powered = rows.mapInPandas(_powered, rows.schema).withColumns({f"h{n}": F.col(f"h{n}").cast("decimal(20,0)") for n in (1, 2)})
    ranged = range_bucketed(powered, ["c"], [F.col("d")])
    sums = running_sums(ranged, ["c"], [F.col("d")], {"s1": "h1", "s2": "h2", "cw": "w"})
    at = lambda value, p: (F.pmod(value, F.lit(p).cast("decimal(20,0)"))).cast("long")
    mark = lambda a, b: F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))
    p1, p2 = HASHES[0][0], HASHES[1][0]
    here = mark(at(F.col("s1"), p1), at(F.col("s2"), p2))
    before = mark(at(F.col("s1") - F.col("h1"), p1), at(F.col("s2") - F.col("h2"), p2))
    return stage(sums.select("c", "d", here.alias("f"), before.alias("pf"), "w", "cw"), "prefixes")


def two_fattest(a: Column, b: Column) -> Column:
    """The number in ``(a, b]`` that the highest power of two divides."""
    bits = F.floor(F.log2(a.bitwiseXOR(b).cast("double"))).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", b, bits), bits)


def exits(ends: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(c, length, m, mf, edge)``: where each conversation of ``ends (c, length)`` leaves the trie ``nodes``.

    ``m`` is the length of its longest prefix in the trie, ``mf`` that prefix; ``edge`` is the node below the edge it leaves, null at a node.
    """
    at = lambda name, f: paths.select("c", F.col("d").alias(name), F.col("f").alias(f))
    state = ends.select("c", "length", F.lit(0).cast("long").alias("lo"), F.col("length").alias("hi"), F.lit(ROOT).alias("node"))
    handles = nodes.where("e > 0").select(F.col("g").alias("ask"), F.col("f").alias("found"), "e")
    deepest = ends.agg(F.max("length").alias("x")).first()["x"] or 0
    for _ in range(int(deepest).bit_length() + 1):
        state = state.withColumn("t", F.when(F.col("lo") < F.col("hi"), two_fattest(F.col("lo"), F.col("hi"))))
        asked = state.join(at("t", "ask"), ["c", "t"], "left").join(handles, "ask", "left")
        hit = F.col("found").isNotNull()
        state = asked.select(
            "c", "length", F.when(hit, F.col("e")).otherwise(F.col("lo")).alias("lo"),
            F.when(hit | F.col("t").isNull(), F.col("hi")).otherwise(F.col("t") - 1).alias("hi"), F.coalesce("found", "node").alias("node"),
        )
        state = stage(state, "search")
    # does the conversation hold the whole prefix of the last node it found, and which child of it does it enter?
    state = state.withColumns({"whole": F.col("lo"), "next": F.col("lo") + 1})
    state = state.join(at("whole", "here"), ["c", "whole"], "left").join(at("next", "first"), ["c", "next"], "left")
    through = (F.col("lo") == 0) | F.coalesce(F.col("here") == F.col("node"), F.lit(False))
    state = state.withColumn("through", through)
    child = nodes.where("e > 0").select("first", F.col("f").alias("child"))
    state = state.join(child, "first", "left").withColumn("edge", F.when(F.col("through"), F.col("child")).otherwise(F.col("node")))
    edges = nodes.select(F.col("f").alias("edge"), "a", F.col("e").alias("to"), "o")
    state = stage(state.join(edges, "edge", "left").select("c", "length", "lo", "node", "edge", "a", "to", "o"), "located")
    # fingerprints that agree along the edge
    own = state.where("edge IS NOT NULL").select("c", "edge", "a", "to", "o").join(paths.select("c", "d", "f"), "c").where("d > a AND d <= to")
    other = paths.select(F.col("c").alias("o"), "d", "f")
    along = own.join(other, ["o", "d", "f"]).groupBy("c").agg(F.max(F.struct("d", "f")).alias("x"))
    out = state.join(along, "c", "left").select(
        "c", "length", F.coalesce("x.d", "lo").alias("m"), F.coalesce("x.f", "node").alias("mf"),
        F.when(F.col("x.d") < F.col("to"), F.col("edge")).alias("edge"),
    )
    return stage(out, "exits")


def _with_marks(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes ``(f, e, o, a, pf)`` with their handle ``g`` and the first prefix of their edge."""
    at = lambda name, f: paths.select(F.col("c").alias("o"), F.col("d").alias(name), F.col("f").alias(f))
    nodes = nodes.withColumns({"t": two_fattest(F.col("a"), F.col("e")), "next": F.col("a") + 1})
    return nodes.join(at("t", "g"), ["o", "t"]).join(at("next", "first"), ["o", "next"]).select("f", "e", "o", "a", "pf", "g", "first")


def insert(nodes: DataFrame, paths: DataFrame, ends: DataFrame) -> DataFrame:
    """The trie ``nodes (f, e, o, a, pf, g, first)`` with the conversations ``ends (c, length, f)`` in it."""
    out = exits(ends, paths, nodes)
    rows = stage(out.join(paths, "c").where("d > m").select("c", "d", "f", "pf", "m", "mf", "length"), "new")
    found = rows.groupBy("d", "f").agg(F.min("pf").alias("pf"), F.min("c").alias("o"), F.max(F.col("d") == F.col("length")).alias("ends"))
    found = stage(found, "found")
    forks = found.groupBy("pf").agg(F.count("*").alias("n")).where("n > 1").select(F.col("pf").alias("f"))
    made = found.where("ends").select("f", "d", "o").unionByName(found.join(forks, "f", "left_semi").select("f", "d", "o")).distinct()
    made = stage(made, "made")
    # parents: the explicit node before, on the owner's path
    steps = rows.join(made.select("f", "o"), "f").select("c", "d", "f", "m", "mf", "o")
    path = Window.partitionBy("c").orderBy("d")
    steps = steps.withColumns({"up": F.lag("d").over(path), "upf": F.lag("f").over(path)}).where("c = o")
    made = steps.select("f", F.col("d").alias("e"), "o", F.coalesce("up", "m").alias("a"), F.coalesce("upf", "mf").alias("pf"))
    # old edges, split where conversations leave them
    cuts = out.where("edge IS NOT NULL").select("edge", F.col("m").alias("e"), F.col("mf").alias("f")).distinct()
    old = nodes.join(cuts.select(F.col("edge").alias("f")).distinct(), "f", "left_semi")
    pieces = cuts.join(old.select(F.col("f").alias("edge"), "o", F.col("a").alias("top"), F.col("pf").alias("topf")), "edge")
    pieces = pieces.unionByName(old.select(F.col("f").alias("edge"), "e", "f", "o", F.col("a").alias("top"), F.col("pf").alias("topf")))
    edge = Window.partitionBy("edge").orderBy("e")
    pieces = pieces.withColumns({"a": F.coalesce(F.lag("e").over(edge), "top"), "pf": F.coalesce(F.lag("f").over(edge), "topf")})
    kept = nodes.join(cuts.select(F.col("edge").alias("f")).distinct(), "f", "left_anti")
    fresh = stage(made.unionByName(pieces.select("f", "e", "o", "a", "pf")), "fresh")
    return stage(kept.unionByName(_with_marks(fresh, paths)), "trie")


def build(paths: DataFrame, ends: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The trie of the distinct conversations ``ends (c, length, f)``, of at least one turn, inserted in ``batches`` by hash."""
    schema = "f string, e long, o long, a long, pf string, g string, first string"
    nodes = ends.sparkSession.createDataFrame([(ROOT, 0, None, None, None, None, None)], schema)
    for n in range(batches):
        nodes = insert(nodes, paths, ends.where(F.pmod(F.xxhash64("c"), F.lit(batches)) == n))
    return nodes


def subtree_sums(nodes: DataFrame, sums: list[str], least: list[str]) -> DataFrame:
    """``nodes (f, pf, ...)`` with each column summed, or its least taken, over the node's subtree, by pointer doubling."""
    combine = [*(F.sum(c).alias(f"_{c}") for c in sums), *(F.min(c).alias(f"_{c}") for c in least)]
    state = nodes.select("f", F.col("pf").alias("up"), *sums, *least)
    while not state.where("up IS NOT NULL").isEmpty():
        below = state.where("up IS NOT NULL").groupBy("up").agg(*combine).withColumnRenamed("up", "f")
        jump = state.select(F.col("f").alias("up"), F.col("up").alias("_next"))
        state = state.join(below, "f", "left").join(jump, "up", "left").select(
            "f", F.col("_next").alias("up"), *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums),
            *(F.least(c, f"_{c}").alias(c) for c in least),
        )
        state = stage(state, "doubled")
    return state.drop("up")


def _listed(batches) -> Iterator[pd.DataFrame]:
    """Members of each node, joined by commas, in pieces of up to ``CHUNK``, from sorted rows."""
    for b in batches:
        out = []
        for f, found in groupby(zip(b["f"], b["c"].tolist()), key=lambda x: x[0]):
            ids = [c for _, c in found]
            out += [(f, ids[i], ",".join(map(str, ids[i : i + CHUNK]))) for i in range(0, len(ids), CHUNK)]
        yield pd.DataFrame(out, columns=["f", "least", "ids"])


def _digests(batches) -> Iterator[pd.DataFrame]:
    now, digest = None, None
    for b in batches:
        out = []
        for f, ids in zip(b["f"], b["ids"]):
            if f != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = f, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
        yield pd.DataFrame(out, columns=["f", "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([(now, digest.hexdigest())], columns=["f", "ends_sha256"])


def end_digests(members: DataFrame) -> DataFrame:
    """``(f, ends_sha256)``: SHA-256 of the ascending, comma-joined members of each end.

    Ids are joined by ranges first, so that the task which hashes a node's members in order reads few rows.
    """
    rows = members.select("f", "c").repartitionByRange("f", "c").sortWithinPartitions("f", "c")
    rows = rows.mapInPandas(_listed, "f string, least long, ids string")
    return rows.repartition("f").sortWithinPartitions("f", "least").mapInPandas(_digests, "f string, ends_sha256 string")


def trie(turns: DataFrame, key: str = "conv_id", batches: int = BATCHES) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` of each node of the trie.

    Conversations are rebuilt (see ``rebuilt``) from ``(key, turn, role, text)``. Rows of equal ``turn`` go by the
    SHA-256 of role and text, so repeated rows are turns each; null roles and texts are empty, rows without a
    key belong to no conversation, other columns are not read. An empty table has no node, not even a root.
    Remainders of negative keys have the key's sign. Very long texts only add to a fingerprint and a count of words.
    """
    convs, rows = rebuilt(ordered_turns(turns, key))
    paths = prefixes(rows)
    last = paths.groupBy("c").agg(F.max(F.struct("d", "f", "cw")).alias("x"))
    members = convs.join(last, "c", "left").select(
        "c", F.coalesce("x.d", F.lit(0)).alias("length"), F.coalesce("x.f", F.lit(ROOT)).alias("f"), F.coalesce("x.cw", F.lit(0)).alias("cw")
    )
    members = stage(members, "members")
    ends = stage(members.groupBy("f", "length", "cw").agg(F.min("c").alias("c"), F.count("*").alias("k")), "ends")
    paths = stage(paths.join(ends.select("c"), "c", "left_semi"), "paths")
    nodes = build(paths, ends.where("length > 0").select("c", "length", "f"), batches)
    return _expanded(nodes, paths, ends, end_digests(members))


def _expanded(nodes: DataFrame, paths: DataFrame, ends: DataFrame, digests: DataFrame) -> DataFrame:
    """One row a node of the trie from its compacted form."""
    words = lambda name, to: paths.select(F.col("c").alias("o"), F.col("d").alias(name), F.col("cw").alias(to))
    nodes = nodes.select("f", "pf", "e", "a", "o").join(words("e", "below"), ["o", "e"], "left").join(words("a", "above"), ["o", "a"], "left")
    children = nodes.where("pf IS NOT NULL").groupBy("pf").agg(F.count("*").alias("n_children")).withColumnRenamed("pf", "f")
    nodes = nodes.join(children, "f", "left").join(ends.select("f", "k", "c", F.col("cw").alias("end_words")), "f", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    nodes = stage(
        nodes.select(
            "f", "pf", "e", "a", "o", zero("below").alias("below"), zero("n_children").alias("n_children"), zero("k").alias("n_convs"),
            (zero("k") * zero("end_words")).alias("read"), (zero("below") - zero("above")).alias("once"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), F.col("c").alias("conv_id"),
        ),
        "explicit",
    )
    sums = subtree_sums(nodes, ["n_convs", "read", "once", "n_leaves"], ["conv_id"])
    # what the words of a subtree below the edge amount to, once
    nodes = nodes.select("f", "pf", "e", "a", "o", "below", "n_children", F.col("once").alias("mine")).join(sums, "f")
    nodes = nodes.withColumn("once", F.col("once") - F.col("mine")).where("n_convs > 0")
    up = nodes.select(F.col("f").alias("pf"), F.col("conv_id").alias("up_id"))
    nodes = stage(nodes.join(up, "pf", "left").join(digests, "f", "left"), "summed")
    depths = F.explode(F.sequence(F.lit(0), F.floor((F.col("e") - F.col("a") - 1) / CHUNK)))
    edges = nodes.where("e > 0").withColumn("part", depths)
    first = F.col("a") + 1 + F.col("part") * CHUNK
    edges = edges.withColumn("d", F.explode(F.sequence(first, F.least(F.col("e"), first + CHUNK - 1))))
    rows = edges.join(paths.select(F.col("c").alias("o"), "d", "w", "cw"), ["o", "d"])
    root = nodes.where("e = 0").withColumns({"d": F.lit(0).cast("long"), "w": F.lit(0).cast("long"), "cw": F.lit(0).cast("long")})
    columns = ["e", "a", "d", "conv_id", "up_id", "n_convs", "n_children", "n_leaves", "read", "once", "below", "w", "cw", "ends_sha256"]
    rows = rows.select(*columns).unionByName(root.select(*columns))
    ends_here = F.col("d") == F.col("e")
    # words of all members from this turn on, less those of each node from here on, once
    start = F.col("cw") - F.col("w")
    rest = F.col("below") - start + F.col("once")
    parent = F.when(F.col("d") == F.col("a") + 1, F.col("up_id")).otherwise(F.when(F.col("d") > 0, F.col("conv_id")))
    return rows.select(
        "conv_id", F.col("d").alias("depth"), parent.alias("parent_conv_id"),
        "n_convs", F.when(ends_here, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("read") - F.col("n_convs") * start - rest).cast("long").alias("saved_tokens"),
        F.coalesce(F.when(ends_here, F.col("ends_sha256")), F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
