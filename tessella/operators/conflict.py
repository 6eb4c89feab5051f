"""Greedy choices over conflict graphs, with a number of tables that does not follow their longest chain.

A few rounds settle what is decided locally, which is nearly everything in usual data. What is left is split into
connected components; components of up to ``LIMIT`` edges are solved whole, many to a task, and only larger ones
go through further rounds, after which they are split again.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import many, stage
from .graph import components

#: Local rounds before components are formed (doubled each time), and edges of a component that a task solves whole.
ROUNDS, LIMIT = 2, 100_000


def split(edges: DataFrame, u: str, v: str, on=()) -> tuple[DataFrame, DataFrame]:
    """Edges of bounded components with their ``label``, and the edges of the larger ones."""
    names = edges.columns
    if edges.limit(LIMIT + 1).count() <= LIMIT:
        return edges.withColumn("label", F.lit("")), edges.where("false")
    # both sides as text, so that ids of two kinds are different nodes
    sided = lambda name, side: F.concat(F.lit(side), F.col(name).cast("string"))
    mark = ("", "") if u == "winner" else ("l", "r")
    tagged = edges.withColumns({"_u": sided(u, mark[0]), "_v": sided(v, mark[1])})
    found = components(tagged.select(*on, F.col("_u").alias("u"), F.col("_v").alias("v")), on).withColumnRenamed("node", "_u")
    tagged = stage(tagged.join(found, [*on, "_u"]).drop("_u", "_v"), "components")
    sizes = tagged.groupBy(*on, "label").agg(F.count("*").alias("_n"))
    tagged = tagged.join(sizes, [*on, "label"])
    return tagged.where(F.col("_n") <= LIMIT).drop("_n"), tagged.where(F.col("_n") > LIMIT).select(*names)


def solved(small: DataFrame, solve: Callable[[list], list], names: list[str], on=()) -> DataFrame:
    """``solve`` on the rows ``names`` of each component; what it returns has the types of the first columns."""
    kinds = dict(small.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for b in batches for row in zip(*(b[c].tolist() for c in ("_key", *names))))
        out: list = []
        for _, found in groupby(rows, key=lambda r: r[0]):
            out += solve([r[1:] for r in found])
            if len(out) > LIMIT:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    key = F.xxhash64(*on, "label").alias("_key")
    dealt = small.select(key, *names).repartition("_key").sortWithinPartitions("_key")
    return dealt.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def _losers(edges: list[tuple]) -> list[tuple]:
    """Edges ``(keeper, loser)``, one for each row that greedy suppression drops, from edges ``(winner, loser)``."""
    below, waiting = defaultdict(list), defaultdict(int)
    for winner, loser in edges:
        below[winner].append(loser)
        waiting[loser] += 1
    out, dropped, ready = [], set(), deque(w for w in below if w not in waiting)
    while ready:
        row = ready.popleft()
        for loser in below[row]:
            if row not in dropped and loser not in dropped:
                dropped.add(loser)
                out.append((row, loser))
            waiting[loser] -= 1
            if not waiting[loser]:
                ready.append(loser)
    return out


def greedy_losers(edges: DataFrame, on=()) -> DataFrame:
    """Rows ``(loser)`` dropped by greedy suppression over ``edges (winner, loser)``.

    Edges must point from better to worse rows of one strict order. With ``on`` they have these keys too, are distinct
    and lie in staged tables: the edges of a key are solved whole in a task, and only keys of over ``LIMIT`` edges go through rounds.
    """
    if on:
        names = ["winner", "loser"]
        large = stage(edges.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > LIMIT).select(*on), "large")
        none = large.isEmpty()
        small = edges if none else edges.join(many(large), list(on), "left_anti")
        dropped = stage(solved(small.withColumn("label", F.lit("")), _losers, names, on).select("loser"), "dead")
        return dropped if none else dropped.unionByName(greedy_losers(edges.join(many(large), list(on), "left_semi")))
    edges = stage(edges.select("winner", "loser").distinct(), "edges")
    none, dropped, rounds, most = edges.select("loser"), [], 0, ROUNDS
    while not edges.isEmpty():
        if rounds == most:
            small, edges = split(edges, "winner", "loser")
            dropped.append(stage(solved(small, _losers, ["winner", "loser"]).select("loser"), "dead"))
            rounds, most, edges = 0, 2 * most, stage(edges, "edges")
            continue
        losers = edges.select(F.col("loser").alias("winner")).distinct()
        safe = edges.join(losers, "winner", "left_anti")
        dead = stage(safe.select("loser").distinct(), "dead")
        dropped.append(dead)
        alive = edges.join(dead, "loser", "left_anti").join(dead.select(F.col("loser").alias("winner")), "winner", "left_anti")
        edges, rounds = stage(alive.select("winner", "loser"), "edges"), rounds + 1
    out = none.where("false")
    for part in dropped:
        out = out.unionByName(part)
    return out


def _matched(edges: list[tuple], keys: int) -> list[tuple]:
    """The pairs that a scan takes, best first, each side once. The last three values of an edge are ``l, r, v``."""
    left, right, out = set(), set(), []
    for e in sorted(edges, key=lambda e: (-e[keys + 2], e[keys], e[keys + 1])):
        a, b = (*e[:keys], e[keys]), (*e[:keys], e[keys + 1])
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append(e)
    return out


def one_to_one(edges: DataFrame, on=()) -> DataFrame:
    """Greedy matching over ``(on, l, r, v)``; order is ``v`` descending, then ``l``, ``r``.

    A pair that is the best of both its sides is always taken by the greedy scan, so all such pairs are taken at once.
    """
    on = list(on)
    names = [*on, "l", "r", "v"]
    edges = stage(edges.select(*names), "edges")
    taken, rounds, most = [edges.where("false")], 0, ROUNDS
    while not edges.isEmpty():
        if rounds == most:
            small, edges = split(edges, "l", "r", on)
            taken.append(stage(solved(small, lambda e: _matched(e, len(on)), names, on), "matched"))
            rounds, most, edges = 0, 2 * most, stage(edges, "edges")
            continue
        order = F.struct("v", (-F.col("l")).alias("nl"), (-F.col("r")).alias("nr"))
        of_left = edges.groupBy(*on, "l").agg(F.max(order).alias("b")).select(*on, "l", (-F.col("b.nr")).alias("r"), "b.v")
        of_right = edges.groupBy(*on, "r").agg(F.max(order).alias("b")).select(*on, (-F.col("b.nl")).alias("l"), "r")
        won = stage(of_left.join(of_right, [*on, "l", "r"], "left_semi").select(*names), "matched")
        taken.append(won)
        rest = edges.join(won.select(*on, "l"), [*on, "l"], "left_anti").join(won.select(*on, "r"), [*on, "r"], "left_anti")
        edges, rounds = stage(rest.select(*names), "edges"), rounds + 1
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out
