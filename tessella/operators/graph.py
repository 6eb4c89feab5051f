"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import stage


def components(edges: DataFrame, on=()) -> DataFrame:
    """``(on, node, label)`` for every node of ``edges (on, u, v)``; the label is the least node.

    Each round hangs every node under its least neighbour, jumps once, and
    contracts the edges, which shrinks them geometrically. Only edge tables and
    node maps are kept; they are written out each round to cut the lineage.
    """
    on = list(on)
    ends = lambda a, b: [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]
    e = stage(edges.where("u <> v").select(*on, *ends("u", "v")).distinct(), "edges")
    maps = []
    while not e.isEmpty():
        both = e.select(*on, F.col("lo").alias("n"), F.col("hi").alias("m")).unionByName(
            e.select(*on, F.col("hi").alias("n"), F.col("lo").alias("m"))
        )
        parent = both.groupBy(*on, "n").agg(F.min("m").alias("m")).select(*on, "n", F.least("n", "m").alias("p"))
        jump = parent.select(*on, F.col("n").alias("p"), F.col("p").alias("q"))
        parent = stage(parent.join(jump, [*on, "p"]).select(*on, "n", F.col("q").alias("p")), "parents")
        maps.append(parent)
        lo = parent.select(*on, F.col("n").alias("lo"), F.col("p").alias("pl"))
        hi = parent.select(*on, F.col("n").alias("hi"), F.col("p").alias("ph"))
        e = stage(
            e.join(lo, [*on, "lo"]).join(hi, [*on, "hi"]).where("pl <> ph").select(*on, *ends("pl", "ph")).distinct(), "edges"
        )
    if not maps:
        return e.select(*on, F.col("lo").alias("node"), F.col("hi").alias("label"))
    out = maps[0].select(*on, F.col("n").alias("node"), F.col("p").alias("label"))
    for step in maps[1:]:
        nxt = step.select(*on, F.col("n").alias("label"), F.col("p").alias("_next"))
        out = out.join(nxt, [*on, "label"], "left").select(*on, "node", F.coalesce("_next", "label").alias("label"))
    return out
