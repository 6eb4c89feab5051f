"""Quality rules as a short-circuit cascade.

A rule is a Boolean column over the metrics of a text. On a sample each rule's cost (seconds for a
row) and selectivity (share of rows rejected) are measured; the rules then run in the order of
rejections per second inside one CASE, which stops at the first rule that rejects. The order only
decides how much work is done: a row is kept when no rule rejects it, in any order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import stage
from .common import ascii_lower, let, spaced_words, text_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Insults of the default rule.
INSULTS = "clown disgusting idiot loser moron pathetic scum stupid trash worthless".split()


def n_repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words. Texts whose hashes are all
    distinct end after one hash set; the others sort (hash, place) pairs once.
    """

    def places(hashes: Column) -> Column:
        def flagged(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
            return F.sort_array(F.transform(at, lambda i: F.get(s, i)["i"]))

        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return let(F.sort_array(pairs), flagged)

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(
            (i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")
        )
        return F.aggregate(p, start, step, lambda a: a["n"])

    def count(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW))
        )
        return let(
            hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(places(h)))
        )

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(words, count)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """``\\n``-split lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def metrics(text: Column, words: Column) -> dict[str, Column]:
    """Metric columns of a text and its words."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": n_dup_lines(text),
        "n_repeat_words": n_repeat_words(words),
    }


@dataclass(frozen=True)
class Rule:
    """``reject`` maps a function from metric names to columns to the rule's Boolean column."""

    name: str
    reject: Callable[[Callable[[str], Column]], Column]


def base_rules(min_words: int = 10, max_repeat_percent: int = 20) -> list[Rule]:
    return [
        Rule("few_words", lambda m: m("n_words") < min_words),
        Rule("repeats", lambda m: m("n_repeat_words") * 100 > m("n_words") * max_repeat_percent),
    ]


def method_rules(
    max_symbol_percent: int = 30, max_dup_line_percent: int = 50, word_length=(2, 15), max_upper_percent: int = 40,
    insults=tuple(INSULTS), insult_percent: int = 1, insult_count: int = 3,
) -> list[Rule]:
    """Symbols, repeated lines, word length, capitals and insults."""
    n = "n_words"
    upper = lambda m: F.length(m("text")) - F.length(F.regexp_replace(m("text"), "[A-Z]", ""))
    hits = lambda m: F.size(F.regexp_extract_all(ascii_lower(m("text")), F.lit(rf"(?<![a-z])(?:{'|'.join(insults)})(?![a-z])"), F.lit(0)))
    lines = lambda m: F.size(F.split(m("text"), "\n"))
    return [
        Rule("symbols", lambda m: m("n_symbols") * 100 > m(n) * max_symbol_percent),
        Rule("repeated_lines", lambda m: m("n_dup_lines") * 100 > lines(m) * max_dup_line_percent),
        Rule("word_length", lambda m: (m("word_chars") < m(n) * word_length[0]) | (m("word_chars") > m(n) * word_length[1])),
        Rule("capitals", lambda m: upper(m) * 100 > F.length(m("text")) * max_upper_percent),
        Rule("insults", lambda m: let(hits(m), lambda h: (h >= insult_count) | ((h > 0) & (h * 100 >= m(n) * insult_percent)))),
    ]


def cascade(rules: list[Rule], text: Column) -> Column:
    """True when no rule rejects ``text``. Words are split once; a metric is computed when its rule is reached."""

    def body(words: Column) -> Column:
        known = metrics(text, words)
        return verdict(rules, lambda name: text if name == "text" else known[name])

    return let(spaced_words(text), body)


def greedy_order(rules: list[Rule], cost: list[float], found: dict[tuple[bool, ...], int]) -> list[Rule]:
    """Rules by rejections per cost, each counted on the texts that the rules before it leave.

    ``found`` counts texts by the verdicts of all rules. Rules that reject nothing more come last, cheapest first.
    """
    out, left = [], list(range(len(rules)))
    while left:
        best = max(left, key=lambda i: (sum(n for hits, n in found.items() if hits[i]) / cost[i], -cost[i]))
        out.append(rules[best])
        left.remove(best)
        found = {hits: n for hits, n in found.items() if not hits[best]}
    return out


def measured_order(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 1000) -> list[Rule]:
    """The rules by rejections per second, measured on ``sample_rows`` rows at most.

    The sample is any few rows of the table; it only orders the work. Each rule is timed twice by itself
    and its shorter time counts; one more pass counts which rules reject the same texts.
    """
    if not rules:
        return []
    rows = stage(docs.select(text_of(text).alias("text")).limit(sample_rows), "sample")
    rejects = lambda rule: ~cascade([rule], F.col("text"))

    def timed(column: Column) -> float:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            rows.agg(F.count_if(column).alias("n")).first()
            best = min(best, time.perf_counter() - start)
        return best

    floor = timed(cascade([], F.col("text")))
    cost = [max(timed(rejects(r)) - floor, 1e-4) for r in rules]
    # at most one row for each row of the sample
    verdicts = rows.groupBy(F.array(*(rejects(r) for r in rules)).alias("hits")).count().collect()
    return greedy_order(rules, cost, {tuple(r["hits"]): r["count"] for r in verdicts})


def verdict(rules: list[Rule], metric: Callable[[str], Column]) -> Column:
    """True when no rule rejects; rules after the first rejection are not evaluated."""
    first, *rest = [F.coalesce(r.reject(metric), F.lit(False)) for r in rules] or [F.lit(False)]
    case = F.when(first, False)
    for reject in rest:
        case = case.when(reject, False)
    return case.otherwise(True)


def score(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", key: str = "doc_id", sample_rows: int = 1000) -> DataFrame:
    """``(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` for each row.

    A null or empty text has no words and fails; repeated rows give repeated results; an
    empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    rules = measured_order(docs, method_rules() if rules is None else rules, text, sample_rows)
    rows = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text"))
    rows = rows.withColumn("_words", spaced_words(F.col("_text")))
    known = metrics(F.col("_text"), F.col("_words"))
    rows = rows.select("_key", "_text", *(c.alias(n) for n, c in known.items()))
    metric = lambda name: F.col("_text") if name == "text" else F.col(name)
    failed = ~verdict(base_rules(), metric)
    return rows.select(
        F.col("_key").alias(key), *known, failed.alias("base_failed"),
        (~failed & verdict(rules, metric)).alias("kept"),
    )


def keep(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = 1000) -> DataFrame:
    """The rows of ``docs``, with their own columns, that no rule rejects.

    Only what a verdict needs is computed: a metric is evaluated when its rule is reached.
    """
    rules = measured_order(docs, [*base_rules(), *method_rules()] if rules is None else rules, text, sample_rows)
    return docs.where(cascade(rules, text_of(docs[text])))
