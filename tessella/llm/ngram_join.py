"""N-gram Jaccard self-join with count vectors and a tree of bounding boxes.

Each text is the set of hashes of its distinct n-word shingles. Hashes are put into groups; the
group counts of a text are a point ("count vector"). The shingles two texts share are at most the
sum over groups of the smaller count, and the same bound holds for a box of points with the box's
upper corner. The join runs in four steps:

1. Exact copies (equal sets) become one representative.
2. The top of the tree is a directory over Spark partitions: all groups are ordered by their total count
   in the corpus, rarest first (ties by hash), and a text is filed under each of its first
   ``n - ceil(t n) + 1`` shingles in that order. If the minima over all these coordinates are zero the bound
   is below the threshold, so every qualifying pair meets in a cell. Cells with one text vanish.
3. Texts of a cell are linked to its first text when the pair, deduplicated over cells, qualifies.
   This joins most copies of a group in a few rows a text.
4. Cells that still hold several components are searched for pairs across components: points of one vector length are
   packed into nodes by size and counts, nodes and then points are bounded on vectors folded to a quarter, the pairs that are left on the
   whole vectors, and the rest is verified exactly. Texts that share several cells are a pair only in the least of them, as far as
   the ``LOW`` least cells of each tell.
   A large cell is split into blocks, and pairs of blocks are the tasks. Two large components may have very many pairs, of which
   one link is enough: a first search gives out the ``FEW`` pairs of the greatest bound for each two components and pair of blocks;
   these are verified and the components contracted. Cells in which pairs were held back are searched
   once more, for all pairs of components that are still apart.

Components are closed under links; a pair inside one component needs no test. All texts count, no cell is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph import components
from ..runtime import stage
from .common import SLOTS, bitmap, marked, pieces, text_of

#: Groups of the corpus-wide order (one byte each is broadcast), and of the count vector of a text of up to ``DENSE`` shingles.
ORDER_BITS, GROUPS, DENSE = 18, 256, 500
#: A count takes one byte, whose largest value stands for any number from there on. Trees are built on one group for ``COARSE``.
FULL, MANY, COARSE = 255, 1 << 30, 4
#: Cells of a text that go along, the least ones.
LOW = 16
#: Rows of a block of a cell, and points of a tree node.
BLOCK, NODE = 1024, 32
#: Texts of a cell that is one leaf, and queries that go through a tree at once.
LEAF, QUERIES = 64, 32
#: Pairs of two components that a block pair gives out before the components are contracted.
FEW = 2
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; shorter texts are one shingle, texts without words none."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mixed(out * _BASE + hashes[i : len(words) - n + 1 + i])
    return np.unique(out)


def need(n, percent: int):
    """Least overlap of a set of ``n`` with any partner: ``ceil(percent * n / 100)``."""
    return (n * percent + 99) // 100


def groups(size: int) -> int:
    """Length of the count vector: larger texts need more groups, or any two would look alike."""
    n = GROUPS
    while n * DENSE < size * GROUPS:
        n *= 2
    return n


def packed(hashes: np.ndarray) -> bytes:
    """The count vector of a set of hashes."""
    parts = groups(len(hashes))
    counts = np.bincount((hashes % np.uint64(parts)).astype(np.int64), minlength=parts)
    return np.minimum(counts, FULL).astype(np.uint8).tobytes()


def added(rows: np.ndarray, length: int) -> np.ndarray:
    """Count vectors added up to ``length`` groups; ``MANY`` and sums beyond stay ``MANY``."""
    return np.minimum(rows.reshape(len(rows), -1, length).sum(1, dtype=np.int64), MANY).astype(np.int32)


def folded(vectors, length: int) -> np.ndarray:
    """Packed count vectors of one length as rows of ``length`` groups; lengths are GROUPS times powers of two.

    A full byte becomes ``MANY``, so minima never fall below the true ones.
    """
    rows = np.frombuffer(b"".join(vectors), np.uint8).reshape(len(vectors), -1)
    return added(np.where(rows == FULL, np.int32(MANY), rows), length)


def _counted(batches, n: int) -> Iterator[pd.DataFrame]:
    total = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in pieces(batches, "t"):
        for text in batch["t"]:
            np.add.at(total, (shingles(text, n) >> np.uint64(64 - ORDER_BITS)).astype(np.int64), 1)
    on = np.flatnonzero(total)
    yield pd.DataFrame({"g": on.astype(np.int32), "c": total[on]})


def corpus_order(docs: DataFrame, n: int, text: str) -> np.ndarray:
    """For each of ``2 ** ORDER_BITS`` groups, a byte that grows with its count over all texts. Bounded by the number of groups."""
    rows = docs.select(text_of(text).alias("t")).mapInPandas(partial(_counted, n=n), "g int, c long")
    sums = rows.groupBy("g").agg(F.sum("c").alias("c")).toPandas()
    order = np.zeros(1 << ORDER_BITS, np.uint8)
    if len(sums):
        order[sums["g"]] = np.minimum(255, 8 * np.log2(sums["c"].to_numpy(float))).astype(np.uint8)
    return order


def _described(batches, n: int, percent: int, order) -> Iterator[pd.DataFrame]:
    rank = order.value
    for batch in pieces(batches, "t"):
        out = []
        for text in batch["t"]:
            s = shingles(text, n)
            size = len(s)
            head = size - need(size, percent) + 1 if size else 0
            place = np.lexsort((s, rank[(s >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]))[:head]
            out.append((size, xxhash.xxh3_128_hexdigest(s.tobytes()), s[place].view(np.int64), packed(s)))
        yield pd.DataFrame({"key": batch["key"]}).join(pd.DataFrame(out, columns=["n", "print", "head", "vector"], index=batch.index))


def described(docs: DataFrame, n: int, percent: int, text: str, key: str) -> DataFrame:
    """Written ``(key, n, print, head, vector)``: set size, fingerprint of the set, directory shingles, count vector."""
    order = docs.sparkSession.sparkContext.broadcast(corpus_order(docs, n, text))
    # the key travels as text, so that nulls do not turn large numbers into floats
    rows = docs.select(F.col(key).cast("long").cast("string").alias("key"), text_of(text).alias("t"))
    schema = "key string, n long, print string, head array<long>, vector binary"
    rows = rows.mapInPandas(partial(_described, n=n, percent=percent, order=order), schema)
    return stage(rows.withColumn("key", F.col("key").cast("long")), "described")


def _sets(batches, n: int, shared) -> Iterator[pd.DataFrame]:
    bits = shared.value
    for batch in pieces(batches, "t"):
        on = marked(bits, batch["slot"].to_numpy())
        keys, sets = batch["key"][on], [shingles(t, n).view(np.int64) for t in batch["t"][on]]
        yield pd.DataFrame({"key": keys, "s": pd.Series(sets, index=keys.index, dtype=object)})


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(u, v)`` whose summed coordinate minima reach the threshold."""

    def test(batches):
        for b in batches:
            for _, same in b.groupby([b["pa"].str.len(), b["pb"].str.len()]):
                length = min(len(same["pa"].iloc[0]), len(same["pb"].iloc[0]))
                lo = np.minimum(folded(same["pa"], length), folded(same["pb"], length)).sum(1)
                yield same.loc[(100 + percent) * lo >= percent * (same["na"] + same["nb"]).to_numpy(), ["u", "v"]]

    a = points.select(F.col("key").alias("u"), F.col("n").alias("na"), F.col("vector").alias("pa"))
    b = points.select(F.col("key").alias("v"), F.col("n").alias("nb"), F.col("vector").alias("pb"))
    sized = pairs.join(a, "u").join(b, "v").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return sized.mapInPandas(test, "u long, v long")


def verified(pairs: DataFrame, points: DataFrame, docs: DataFrame, n: int, percent: int, text: str, key: str) -> DataFrame:
    """Written links ``(u, v)``: bounded first, then counted on the whole sets of the texts that are left."""
    pairs = stage(_bounded(pairs, points, percent), "bounded")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    # a text goes on if its slot is marked: those of no pair that share a slot are dropped by the joins
    slot = F.pmod(F.xxhash64("key"), F.lit(SLOTS)).alias("slot")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(ends.select(slot)))
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("t")).where("key IS NOT NULL").select("key", "t", slot)
    sets = stage(rows.mapInPandas(partial(_sets, n=n, shared=shared), "key long, s array<long>"), "sets")
    a, b = (sets.select(F.col("key").alias(k), F.col("s").alias(f"s{x}")) for k, x in (("u", "a"), ("v", "b")))
    size = lambda c: F.size(c).cast("long")
    good = size(F.array_intersect("sa", "sb")) * (100 + percent) >= (size("sa") + size("sb")) * percent
    return stage(pairs.join(a, "u").join(b, "v").where(good).select("u", "v").distinct(), "links")


class Tree:
    """Points packed into nodes of ``NODE`` by (size, counts), each with its largest counts and its range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 0], points[:, 1], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.starts = np.arange(0, len(sizes), NODE)
        self.upper = np.maximum.reduceat(self.points, self.starts, axis=0)
        self.least, self.most = np.minimum.reduceat(self.sizes, self.starts), np.maximum.reduceat(self.sizes, self.starts)

    def search(self, points: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (number of a query, number of a point of the tree) whose bound reaches the threshold, and the bound over both sizes."""
        fits = (self.most[None] * 100 >= sizes[:, None] * percent) & (self.least[None] * percent <= sizes[:, None] * 100)
        q, node = np.nonzero(fits)
        bound = np.minimum(self.upper[node], points[q]).sum(1)
        # a partner of size m needs an overlap of percent / (100 + percent) of both sizes
        good = (100 + percent) * bound >= percent * (sizes[q] + np.maximum(self.least[node], need(sizes[q], percent)))
        q, node = q[good], node[good]
        at = (self.starts[node][:, None] + np.arange(NODE)).ravel()
        q = np.repeat(q, NODE)
        q, at = q[at < len(self.sizes)], at[at < len(self.sizes)]
        both = np.minimum(self.points[at], points[q]).sum(1)
        total = sizes[q] + self.sizes[at]
        good = (100 + percent) * both >= percent * total
        return q[good], self.order[at[good]], both[good] / total[good]


def _least(cells, cell: int) -> np.ndarray:
    """Lists of cells as rows of ``LOW``, filled up with ``cell``."""
    out = np.full((len(cells), LOW), cell)
    for row, known in zip(out, cells):
        row[: len(known)] = known
    return out


def _between(left: pd.DataFrame, right: pd.DataFrame, length: int, percent: int) -> Iterator[pd.DataFrame]:
    """Bounded pairs of texts of two components, from vectors folded to one length, a few queries at a time.

    A pair that is known to share a lesser cell is left to that cell.
    """
    cell, coarse = left["cell"].iloc[0], max(1, length // COARSE)
    a, b = folded(left["vector"], length), folded(right["vector"], length)
    low_a, low_b = _least(left["low"], cell), _least(right["low"], cell)
    sizes, others = left["n"].to_numpy(), right["n"].to_numpy()
    tree, points = Tree(added(b, coarse), others), added(a, coarse)
    label_a, label_b = left["label"].to_numpy(), right["label"].to_numpy()
    # so many queries at once that a step holds a few million numbers
    step = max(1, QUERIES * GROUPS // length)
    for at in range(0, len(left), step):
        q, p, _ = tree.search(points[at : at + step], sizes[at : at + step], percent)
        q += at
        on = label_a[q] != label_b[p]
        q, p = q[on], p[on]
        seen = ((low_a[q][:, :, None] == low_b[p][:, None, :]) & (low_a[q] < cell)[:, :, None]).any((1, 2))
        q, p = q[~seen], p[~seen]
        both, total = np.minimum(a[q], b[p]).sum(1), sizes[q] + others[p]
        on = (100 + percent) * both >= percent * total
        u, v, bound = left.iloc[q[on]], right.iloc[p[on]], both[on] / total[on]
        u, v = ({c: x[c].to_numpy() for c in ("key", "label")} for x in (u, v))
        yield pd.DataFrame({
            "u": np.minimum(u["key"], v["key"]), "v": np.maximum(u["key"], v["key"]), "bound": bound,
            "a": np.minimum(u["label"], v["label"]), "b": np.maximum(u["label"], v["label"]),
        })


def _best(found: pd.DataFrame, few: int | None) -> tuple[pd.DataFrame, bool]:
    """The ``few`` pairs of the greatest bound for each two components, and whether others were held back."""
    found = found.drop_duplicates(["u", "v"])
    if few is None:
        return found, False
    found = found.sort_values(["a", "b", "bound", "u", "v"], ascending=[True, True, False, True, True])
    kept = found[found.groupby(["a", "b"]).cumcount() < few]
    return kept, len(kept) < len(found)


def _crossed(pdf: pd.DataFrame, percent: int, few: int | None) -> pd.DataFrame:
    """Pairs of two blocks of one cell (or of one block) that lie in different components and pass the bounds.

    ``more`` says that pairs were held back. Lengths of vectors are compared at the shorter of the two.
    """
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if not len(right):
        right = left
    size = lambda x: x["vector"].str.len()
    kept, more = pd.DataFrame({c: [] for c in ("u", "v", "bound", "a", "b")}), False
    for m, a in left.groupby(size(left)):
        for n, b in right.groupby(size(right)):
            for found in _between(a, b, int(min(m, n)), percent):
                if len(found):
                    kept, held = _best(pd.concat([kept, found]) if len(kept) else found, few)
                    more = more or held
    out = kept[["u", "v"]].astype("int64")
    return out.assign(cell=pdf["cell"].iloc[0], more=more)


def across(cells: DataFrame, labels: DataFrame, points: DataFrame, percent: int, few: int | None) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs ``(u, v)`` of texts that share a cell ``(cell, key, n)`` but no component, and cells with pairs held back.

    Cells of up to ``LEAF`` texts are single leaves, whose pairs a join forms; larger ones get a tree.
    """
    rows = cells.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    rows = stage(rows.select("cell", "key", "n", "label"), "labelled")
    mixed = rows.groupBy("cell").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("m")).where("a < b")
    rows = stage(rows.join(mixed.select("cell", "m"), "cell"), "mixed")
    leaf = rows.where(F.col("m") <= LEAF)
    a = leaf.select("cell", F.col("key").alias("u"), F.col("n").alias("na"), F.col("label").alias("la"))
    b = leaf.select("cell", F.col("key").alias("v"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    sized = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    near = a.join(b, "cell").where((F.col("u") < F.col("v")) & (F.col("la") != F.col("lb")) & sized).select("u", "v")
    # blocks by hash, so that no row number over a large cell is needed
    points = points.select("key", "vector", F.slice(F.array_sort("head"), 1, LOW).alias("low"))
    large = rows.where(F.col("m") > LEAF).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    large = large.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).join(points, "key")
    # block i meets every block j: as the left side with j >= i, as the right side with j <= i
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), (F.col("block") > j).cast("int").alias("side")),
    )
    spread = large.withColumn("p", F.explode(pair)).select("cell", "p.i", "p.j", "p.side", "key", "label", "n", "vector", "low")
    found = spread.groupBy("cell", "i", "j").applyInPandas(partial(_crossed, percent=percent, few=few), "u long, v long, cell long, more boolean")
    found = stage(found, "crossed")
    return near.unionByName(found.select("u", "v")).distinct(), found.where("more").select("cell").distinct()


def join(docs: DataFrame, n: int = 4, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_shingles, component_id)`` for each row of ``docs``; sets link when ``100 * overlap >= percent * union``.

    Texts without words have an empty set, linked with nothing: their component is their own key.
    Rows that repeat a text are exact copies. A row with a null key gets the component of its exact
    copies, or null. Keys are integers; rows that share a key are one node of the graph.
    """
    rows = described(docs, n, percent, text, key)
    full = rows.where("n > 0")
    prints = stage(full.groupBy("print").agg(F.min("key").alias("rep")), "prints")
    # the description of each representative (any of equal copies)
    points = full.where("key is not null").join(prints.select("print", F.col("rep").alias("key")), ["print", "key"], "left_semi")
    points = stage(points.dropDuplicates(["print", "key"]), "points")
    filed = points.select("key", "n", F.explode("head").alias("cell"))
    counts = filed.groupBy("cell").agg(F.count("*").alias("m"), F.min("key").alias("first")).where("m > 1")
    cells = stage(filed.join(counts.select("cell", "first"), "cell"), "cells")
    star = cells.where("key <> first").select(F.col("first").alias("u"), F.col("key").alias("v")).distinct()
    links = verified(star, points, docs, n, percent, text, key)
    for few in (FEW, None):
        labels = stage(components(links).select(F.col("node").alias("key"), "label"), "components")
        pairs, held = across(cells.select("cell", "key", "n"), labels, points, percent, few)
        links = stage(links.unionByName(verified(pairs, points, docs, n, percent, text, key)).distinct(), "all-links")
        if few is not None:
            cells = stage(cells.join(held, "cell", "left_semi"), "held")
            if cells.isEmpty():
                break
    # keys of one text join through its representative; rows that share a key through the key
    same = full.where("key is not null").join(prints, "print").where("key <> rep").select(F.col("rep").alias("u"), F.col("key").alias("v"))
    shared = same.join(full.groupBy("key").agg(F.count_distinct("print").alias("d")).where("d > 1").select(F.col("key").alias("v")), "v", "left_semi")
    label = components(links.union(shared.select("u", "v"))).select(F.col("node").alias("rep"), "label")
    out = rows.join(prints, "print", "left").join(label, "rep", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("label", "rep", "key").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 4, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with their own columns, whose key is the least of its component.

    Texts without words stay. Rows that share both key and component stay together, as one document.
    """
    out = join(docs, n, percent, text, key)
    gone = out.where(F.col("component_id") != F.col(key)).select(F.col(key).cast("long").alias("_gone")).distinct()
    return docs.join(gone, docs[key].cast("long") == gone["_gone"], "left_anti")
