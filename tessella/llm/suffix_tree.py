"""Language-model scoring with a probabilistic suffix tree over words.

Contexts of up to ``depth`` words grow level by level: a context is a candidate when it is seen at
least ``CONTEXT * sqrt(n)`` times in ``n`` training tokens, and is kept when its next-word distribution gains at
least ``divergence`` nats a token over that of its longest kept suffix. A state gives a word
``(k + (n - K + a) * P_suffix(word)) / (n + a)``: its own counts ``k`` for the words it stores (``K`` in
all, words seen ``JOINT * sqrt(n)`` times after it), the rest of its mass by its suffix. The empty context is the
add-one unigram model of all words.

The floors rise with the square root of the corpus, so rarer and rarer contexts come in as it grows, each on more
evidence than before. A level has at most ``sqrt(n) / CONTEXT`` contexts and ``sqrt(n) / JOINT`` transitions: the tree grows
with the input. Tasks hold it whole, at 16 bytes a row; if all these rows exist, two levels take 0.17 GB at 10^10 tokens and
5.4 GB at 10^13. Words below the floor of the numbered ones are scored by a join with the full counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import stage
from .common import ascii_lower, pieces, spaced_words, text_of

END = "\n"
#: Floors of contexts and of stored next words, as multiples of the square root of the training tokens.
CONTEXT, JOINT = 0.3, 0.02


@dataclass(eq=False)
class Level:
    """Contexts of one length. Context ``j`` is named by ``names[j]`` = (context of one word less) * symbols + last word."""

    names: np.ndarray
    size: np.ndarray
    kept: np.ndarray = None
    codes: np.ndarray = None  # context * symbols + next word
    counts: np.ndarray = None
    stored: np.ndarray = None  # K of each context


@dataclass(eq=False)
class Tree:
    words: dict[bytes, int]
    logs: np.ndarray  # log10 of the root's probability, by word number
    symbols: int  # words numbered below this can stand in contexts and be stored as next words
    prior: float
    levels: list[Level] = field(default_factory=list)


def _find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table, -1 if absent."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1)


def _numbered(texts: pd.Series, tree: Tree):
    """Word numbers of all texts in a row, an end after each; the row of each token; words without a number by row."""
    get, ids, sizes, rest = tree.words.get, [], [], []
    for text in texts:
        words = text.encode("utf-8", "replace").lower().split()
        found = [get(w, -1) for w in words]
        rest.append([w.decode() for w, i in zip(words, found) if i < 0])
        found.append(tree.words[END.encode()])
        ids.append(np.array(found, dtype=np.int64))
        sizes.append(len(found))
    return (np.concatenate(ids) if ids else np.empty(0, np.int64)), np.repeat(np.arange(len(sizes)), sizes), np.array(sizes), rest


def _states(tree: Tree, ids: np.ndarray, row: np.ndarray, levels: int) -> list[np.ndarray]:
    """For each level the context before each token, -1 where there is none."""
    out, before = [], np.zeros(len(ids), np.int64)
    for level in tree.levels[:levels]:
        state = np.full(len(ids), -1)
        if len(ids) > 1:
            same = (row[1:] == row[:-1]) & (ids[:-1] >= 0) & (ids[:-1] < tree.symbols) & (before[:-1] >= 0)
            state[1:][same] = _find(level.names, before[:-1][same] * tree.symbols + ids[:-1][same])
        out.append(state)
        before = state
    return out


def is_training(key: Column, parts: int = 7, held: int = 2) -> Column:
    """False for keys whose CRC-32, as text, leaves ``held``; a null key is training."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts != held, F.lit(True))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, c)`` over whole texts, with one end a row as the word ``"\\n"``."""
    words = F.concat(spaced_words(ascii_lower(text_of(text))), F.array(F.lit(END)))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("c"))


def _transitions(docs: DataFrame, text: str, shared, level: int) -> DataFrame:
    """Counts ``(code, k)`` of next words after the contexts of a level."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = shared.value
        for batch in pieces(batches, "t"):
            ids, row, _, _ = _numbered(batch["t"], tree)
            state = _states(tree, ids, row, level)[-1]
            good = (state >= 0) & (ids >= 0) & (ids < tree.symbols)
            codes, counts = np.unique(state[good] * tree.symbols + ids[good], return_counts=True)
            yield pd.DataFrame({"code": codes, "k": counts})

    rows = docs.select(text_of(text).alias("t")).mapInPandas(count, "code long, k long")
    return rows.groupBy("code").agg(F.sum("k").alias("k"))


def _probability(tree: Tree, levels: list[Level], states: list[np.ndarray], ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probability of each next word from ``start`` (the root's), through the kept contexts, shortest first."""
    p = start
    for level, state in zip(levels, states):
        on = np.flatnonzero(state >= 0)
        on = on[level.kept[state[on]]]
        s = state[on]
        stored = _find(level.codes, np.where(ids[on] >= 0, s * tree.symbols + ids[on], -1)) if len(on) else s
        stored = np.where((ids[on] >= 0) & (ids[on] < tree.symbols), stored, -1)
        k = np.where(stored >= 0, level.counts[stored] if len(level.counts) else 0, 0)
        p[on] = (k + (level.size[s] - level.stored[s] + tree.prior) * p[on]) / (level.size[s] + tree.prior)
    return p


def _test(tree: Tree, level: Level, divergence: float) -> None:
    """Keep the contexts that gain enough over their longest kept suffix."""
    at, word = level.codes // tree.symbols, level.codes % tree.symbols
    level.stored = np.bincount(at, level.counts, minlength=len(level.names))
    # each context's shorter suffixes, from its words
    words, names = [], level.names
    for upper in reversed(tree.levels[: tree.levels.index(level)]):
        words.append(names % tree.symbols)
        names = upper.names[names // tree.symbols]
    words = (words + [names % tree.symbols])[::-1]  # oldest word first
    chain = []
    for n in range(1, tree.levels.index(level) + 1):
        state = np.zeros(len(level.names), np.int64)
        for depth, w in enumerate(words[-n:]):
            state = np.where(state >= 0, _find(tree.levels[depth].names, state * tree.symbols + w), -1)
        chain.append(state)
    upper = tree.levels[: len(chain)]
    shorter = _probability(tree, upper, [c[at] for c in chain], word, 10.0 ** tree.logs[word])
    full = level.size[at] + tree.prior
    own = (level.counts + (level.size[at] - level.stored[at] + tree.prior) * shorter) / full
    rest = level.size - level.stored
    gain = np.bincount(at, level.counts * np.log(own / shorter), minlength=len(level.names))
    gain = gain + rest * np.log((rest + tree.prior) / (level.size + tree.prior))
    level.kept = gain >= divergence * level.size


def fit(
    docs: DataFrame, text: str = "text", depth: int = 2, p_head: float = 2e-6, p_context: float | None = None,
    p_joint: float | None = None, divergence: float = 0.01, prior: float = 5.0,
) -> tuple[Tree, DataFrame, int, int]:
    """The tree, the written table ``(word, c)``, and the numbers of tokens and of distinct tokens, over all ``docs``.

    ``p_context`` and ``p_joint`` set floors as shares of the tokens instead of those that follow the square root.
    ``p_head`` only says which words are numbered, and so scored without a join; words of contexts always are.
    """
    spark = docs.sparkSession
    vocabulary = stage(word_counts(docs, text), "vocabulary")
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    least = max(1.0, CONTEXT * n**0.5 if p_context is None else p_context * n)
    least_joint = max(1.0, JOINT * n**0.5 if p_joint is None else p_joint * n)
    # at most 1 / p_head or n / least rows
    head = vocabulary.where((F.col("c") >= min(p_head * n, least)) | (F.col("word") == END)).toPandas()
    head = head.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    if not (head["word"] == END).any():
        head.loc[len(head)] = [END, 0]
    counts = head["c"].to_numpy(np.int64)
    tree = Tree(
        {w.encode(): i for i, w in enumerate(head["word"])}, np.log10((counts + 1) / (n + v + 1)),
        int((counts >= least).sum()), prior,
    )
    names, size = np.arange(tree.symbols), counts[: tree.symbols]
    inner = names != tree.words[END.encode()]  # nothing follows an end
    names, size = names[inner], size[inner]
    while len(tree.levels) < depth and len(names):
        level = Level(names, size)
        tree.levels.append(level)
        shared = spark.sparkContext.broadcast(tree)
        rows = _transitions(docs, text, shared, len(tree.levels))
        rows = rows.where(F.col("k") >= least_joint).toPandas().sort_values("code")  # at most n / least_joint rows
        level.codes, level.counts = rows["code"].to_numpy(np.int64), rows["k"].to_numpy(np.int64)
        _test(tree, level, divergence)
        grown = (level.counts >= least) & (level.codes % tree.symbols != tree.words[END.encode()])
        names, size = level.codes[grown], level.counts[grown]
    return tree, vocabulary, n, v


def score(docs: DataFrame, model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``.

    Null and empty texts are one end. Words never seen get the root's add-one share. Repeated
    rows are scored each; an empty table gives no rows; an untrained model gives all words equal shares.
    """
    tree, vocabulary, n, v = model
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, first = shared.value, TaskContext.get().partitionId() << 40
        for batch in pieces(batches, "t"):
            ids, row, sizes, rest = _numbered(batch["t"], tree)
            head = ids >= 0
            base = np.where(head, tree.logs[ids], 0.0)
            # words without a number start from 1: what is left is their factor on the root's share
            p = _probability(tree, tree.levels, _states(tree, ids, row, len(tree.levels)), ids, 10.0**base)
            total = lambda x: np.bincount(row, x, minlength=len(sizes))
            yield pd.DataFrame({
                "row": first + np.arange(len(batch)), "key": batch["key"], "held": batch["held"], "n": sizes,
                "head": total(head).astype(np.int64), "base": total(base), "score": total(np.log10(p)), "rest": rest,
            })
            first += len(batch)

    # the key travels as text, so that nulls do not turn large numbers into floats
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).cast("string").alias("key"), (~is_training(F.col(key))).alias("held"), text_of(text).alias("t"))
    schema = "row long, key string, held boolean, n long, head long, base double, score double, rest array<string>"
    rows = stage(rows.mapInPandas(known, schema), "scored")
    rare = rows.select("row", F.explode("rest").alias("word")).join(vocabulary, "word", "left")
    share = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))
    rare = rare.groupBy("row").agg(F.sum(share).alias("_share"), F.count("c").alias("_known"))
    more = F.coalesce("_share", F.lit(0.0))
    end_known = F.lit(0 if n else 1)  # an untrained model does not know the end
    return rows.join(rare, "row", "left").select(
        F.col("key").cast(kind).alias(key), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("head") + F.coalesce("_known", F.lit(0)) - end_known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
