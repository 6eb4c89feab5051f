"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Learning uses a bounded sample of the labelled training texts (``rows``, picked by a hash of the text;
equal texts are one example, labelled by their mean). Terms are words; those found in ``least`` texts that go with or
against the label, surely (chi-squared) and strongly (``lift`` times its share, or that part of it), are indexed. An example is the vector of ``(1 + log tf) * idf`` of its terms, of length 1.

The index is inverted and cut in blocks of ``BLOCK`` examples: a term has a largest weight for each block it
occurs in. A query adds up these maxima times its own weights, which bounds the cosine of all examples of a
block, scores blocks exactly in falling order of the bound, and stops when the next bound is below its k-th best
cosine, so the k nearest are exact. Examples are ordered by their heaviest term, which keeps blocks alike.

Neighbours vote with weight ``cos / (1.1 - cos)``. Vote shares of the training texts themselves, where a text
never votes for its own copies, are binned and made monotone: the share of label 1 in a bin is the calibrated score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import stage
from .common import alnum_words, ascii_lower, pieces, text_of

BLOCK, BINS = 64, 20
#: Bytes of a word as they are, A-Z in lower case, other ASCII as a blank.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def is_training(key: Column, parts: int = 3, held: int = 1) -> Column:
    """False for keys whose CRC-32, as text, leaves ``held``; a null key is training."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts != held, F.lit(True))


def term_counts(text: str, terms: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the indexed terms of a text, ascending, and how often they occur."""
    get = terms.get
    found = [i for i in map(get, text.encode("utf-8", "replace").translate(_WORD_BYTES).split()) if i is not None]
    return np.unique(np.array(found, dtype=np.int64), return_counts=True)


def weighted(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of length 1."""
    w = (1 + np.log(counts)) * idf[ids]
    return w / np.sqrt((w * w).sum()) if len(w) else w


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the number of the range of each."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner], owner


@dataclass(eq=False)
class Index:
    """Postings by (term, block), each block entry with its largest weight. Examples are numbered in index order."""

    entry_at: np.ndarray  # entries of term t are entry_at[t] .. entry_at[t + 1]
    block: np.ndarray
    top: np.ndarray
    post_at: np.ndarray  # postings of entry e are post_at[e] .. post_at[e + 1]
    example: np.ndarray
    weight: np.ndarray
    n: int

    @classmethod
    def of(cls, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> Index:
        ids = np.concatenate([v[0] for v in vectors] or [np.empty(0, np.int64)])
        weight = np.concatenate([v[1] for v in vectors] or [np.empty(0)])
        example = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
        order = np.lexsort((example, ids))
        ids, weight, example = ids[order], weight[order], example[order]
        blocks = max(1, -(-len(vectors) // BLOCK))
        entry = ids * blocks + example // BLOCK
        at = np.flatnonzero(np.diff(entry, prepend=-1)) if len(entry) else np.empty(0, np.int64)
        top = np.maximum.reduceat(weight, at) if len(at) else np.empty(0)
        entry_at = np.searchsorted(ids[at], np.arange(terms + 1))
        return cls(entry_at, entry[at] % blocks, top, np.append(at, len(ids)), example, weight, len(vectors))

    def nearest(self, ids: np.ndarray, query: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``k`` examples of the greatest cosine above zero (ties: the lower number), the cosines, and how many blocks were scored."""
        entries, owner = _ranges(self.entry_at[ids], self.entry_at[ids + 1])
        blocks, share = self.block[entries], query[owner]
        bound = np.bincount(blocks, share * self.top[entries])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        scores, done, step, worst = np.zeros(self.n), 0, 2, 0.0
        while done < len(order) and bound[order[done]] >= worst - 1e-9:
            now = np.zeros(len(bound), bool)
            now[order[done : done + step]] = True
            on = np.flatnonzero(now[blocks])
            posts, at = _ranges(self.post_at[entries[on]], self.post_at[entries[on] + 1])
            scores += np.bincount(self.example[posts], share[on][at] * self.weight[posts], self.n)
            if without >= 0:
                scores[without] = 0
            found = np.flatnonzero(scores)
            if len(found) >= k:
                worst = np.partition(scores[found], len(found) - k)[len(found) - k]
            done, step = done + step, step * 2
        found = np.flatnonzero(scores)
        best = found[np.lexsort((found, -scores[found]))[:k]]
        return best, scores[best], min(done, len(order))


@dataclass(eq=False)
class Model:
    """Of bounded size: at most ``terms`` terms, ``rows`` examples and ``postings`` postings."""

    terms: dict[bytes, int]
    idf: np.ndarray
    index: Index
    keys: list[int | None]
    label: np.ndarray
    number: dict[str, int]  # by the MD5 of the text

    def vote(self, text: str, k: int) -> tuple[float | None, float, list]:
        """Vote share of label 1 among the nearest (None without any), their greatest cosine, and the three nearest keys."""
        ids, counts = term_counts(text, self.terms)
        if not len(ids) or not self.index.n:
            return None, 0.0, []
        own = self.number.get(hashlib.md5(text.encode("utf-8", "replace")).hexdigest(), -1)
        near, cos, _ = self.index.nearest(ids, weighted(ids, counts, self.idf), k, own)
        if not len(near):
            return None, 0.0, []
        w = cos / (1.1 - np.minimum(cos, 1))
        return float((w * self.label[near]).sum() / w.sum()), float(min(cos[0], 1)), [self.keys[i] for i in near[:3]]


def training_texts(docs: DataFrame, labels: DataFrame, rows: int, text: str, key: str, label: str) -> DataFrame:
    """Written ``(print, key, y, t)``: about ``rows`` labelled training texts at most, equal texts once."""
    narrow = docs.where(is_training(F.col(key)) & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.md5(F.col(text).cast("string")).alias("print"))
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.avg(label).alias("y"))
    marked = narrow.join(known, "key").groupBy("print").agg(F.avg("y").alias("y"), F.min("key").alias("key"))
    marked = stage(marked, "labelled")
    # the same share of all texts by their hash, so that the sample does not grow
    share = min(1.0, rows / max(1, marked.count()))
    picked = marked.where(F.conv(F.substring("print", 1, 8), 16, 10).cast("double") < share * 2.0**32)
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")).where("key IS NOT NULL AND t IS NOT NULL")
    found = texts.join(F.broadcast(picked), "key").where(F.md5("t") == F.col("print"))
    return stage(found.select("print", "key", "y", "t").dropDuplicates(["print"]), "training")


def select_terms(training: DataFrame, least: int, chi: float, lift: float, terms: int) -> tuple[pd.DataFrame, int]:
    """The terms that go with the label, with the number of texts ``df`` that hold them, and the number of texts."""
    total = training.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("y")).first()
    n, pos = float(total["n"]), float(total["y"])
    words = training.select("y", F.explode(F.array_distinct(alnum_words(ascii_lower(text_of("t"))))).alias("term"))
    found = words.groupBy("term").agg(F.count("*").alias("df"), F.sum("y").alias("x")).where(F.col("df") >= least)
    off = F.lit(n) * F.col("x") - F.lit(pos) * F.col("df")
    spread = F.lit(pos * (n - pos)) * F.col("df") * (F.lit(n) - F.col("df"))
    found = found.withColumn("chi", F.when(spread > 0, F.lit(n) * off * off / spread).otherwise(F.lit(0.0))).where(F.col("chi") >= chi)
    # chi-squared alone lets in ever more common words as the sample grows
    share = F.col("x") * n / (F.col("df") * pos) if pos else F.lit(1.0)
    found = found.where((share >= lift) | (share * lift <= 1))
    # at most `terms` rows
    return found.orderBy(F.col("chi").desc(), "term").limit(terms).select("term", "df").toPandas().sort_values("term", ignore_index=True), int(n)


def _vectors(training: DataFrame, shared, postings: int) -> pd.DataFrame:
    """``(print, key, y, ids, counts)`` of the examples that hold a term, in the order of their hash, up to ``postings`` numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches, "t"):
            found = [term_counts(t, shared.value) for t in batch["t"]]
            batch = batch[["print", "key", "y"]].assign(ids=[f[0] for f in found], counts=[f[1] for f in found])
            yield batch[batch["ids"].str.len() > 0]

    rows = training.select("print", F.col("key").cast("string").alias("key"), "y", "t")
    rows = rows.mapInPandas(count, "print string, key string, y double, ids array<long>, counts array<long>")
    # a running sum over the bounded sample
    used = F.sum(F.size("ids")).over(Window.orderBy("print"))
    rows = stage(rows, "vectors")
    size = rows.select("print", "ids").withColumn("used", used).where(F.col("used") <= postings).select("print")
    return rows.join(F.broadcast(size), "print").toPandas().sort_values("print", ignore_index=True)


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows: int = 20_000,
    terms: int = 4096, postings: int = 2_000_000, least: int = 5, chi: float = 25.0, lift: float = 2.0,
) -> tuple[Model, DataFrame]:
    """The model, and the written training texts ``(print, key, y, t)``. ``labels`` are 0 or 1; several of a key are averaged."""
    training = training_texts(docs, labels, rows, text, key, label)
    chosen, n = select_terms(training, least, chi, lift, terms)
    numbers = {t.encode(): i for i, t in enumerate(chosen["term"])}
    idf = np.log((n + 1) / (chosen["df"].to_numpy(float) + 1))
    found = _vectors(training, docs.sparkSession.sparkContext.broadcast(numbers), postings)
    vectors = [(np.asarray(i), weighted(np.asarray(i), np.asarray(c), idf)) for i, c in zip(found["ids"], found["counts"])]
    heaviest = [(int(i[w.argmax()]), -w.max()) for i, w in vectors]
    order = sorted(range(len(vectors)), key=lambda j: (heaviest[j], j))
    index = Index.of([vectors[j] for j in order], len(numbers))
    number = {found["print"][j]: at for at, j in enumerate(order)}
    return Model(numbers, idf, index, [found["key"][j] for j in order], found["y"].to_numpy(float)[order], number), training


def monotone(share: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest non-falling values, by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for s, w in zip(share, weight):
        pools.append([s, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([p[0] for p in pools], [p[2] for p in pools])


def _bin(vote: Column) -> Column:
    return F.when(vote.isNull(), -1).otherwise(F.least(F.floor(vote * BINS), F.lit(BINS - 1))).cast("int")


def calibrated(votes: DataFrame) -> list[float]:
    """Scores of texts without a neighbour, then of each bin, from training votes ``(vote, y)``; one doubtful row is added to each bin."""
    sums = {r["bin"]: (r["y"], r["n"]) for r in votes.groupBy(_bin(F.col("vote")).alias("bin")).agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()}
    y, n = (np.array([sums.get(b, (0.0, 0))[i] for b in range(-1, BINS)], float) for i in (0, 1))
    # the doubtful row of a bin is as toxic as the vote says; without neighbours, as the corpus
    doubt = np.append(y.sum() / n.sum() if n.sum() else 0.5, (np.arange(BINS) + 0.5) / BINS)
    share = (y + doubt) / (n + 1)
    return [float(share[0]), *map(float, monotone(share[1:], n[1:] + 1))]


def score(
    docs: DataFrame, model: Model, training: DataFrame, text: str = "text", key: str = "doc_id", k: int = 15, threshold: float = 0.7
) -> DataFrame:
    """``(key, held_out, score, predicted, vote, nearest, evidence)`` for each row of ``docs``.

    ``vote`` is the vote share of label 1 (null without a neighbour), ``nearest`` the greatest cosine, ``evidence`` the keys
    of the nearest examples. Null and empty texts have no neighbour. Repeated rows are scored each; ties among
    examples go to the lower index number; an empty table gives no rows; without labels every score is 0.5.
    Other columns are not read. Whole texts count, of any length.
    """
    kind = dict(docs.dtypes)[key]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in pieces(batches, "t"):
            found = [model.vote(t, k) for t in batch["t"]]
            yield batch.drop(columns="t").assign(vote=[f[0] for f in found], nearest=[f[1] for f in found], evidence=[f[2] for f in found])

    schema = "key string, held boolean, vote double, nearest double, evidence array<string>"
    rows = docs.select(F.col(key).cast("string").alias("key"), (~is_training(F.col(key))).alias("held"), text_of(text).alias("t"))
    rows = stage(rows.mapInPandas(voted, schema), "votes")
    known = stage(training.select("y", F.lit("").alias("key"), F.lit(False).alias("held"), "t").mapInPandas(
        lambda batches: (pd.DataFrame({"vote": [shared.value.vote(t, k)[0] for t in b["t"]], "y": b["y"]}) for b in pieces(batches, "t")),
        "vote double, y double",
    ), "training-votes")
    scores = F.array(*map(F.lit, calibrated(known)))
    out = rows.withColumn("score", F.element_at(scores, _bin(F.col("vote")) + 2))
    return out.select(
        F.col("key").cast(kind).alias(key), F.col("held").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        "vote", "nearest", F.col("evidence").cast(f"array<{kind}>").alias("evidence"),
    )
