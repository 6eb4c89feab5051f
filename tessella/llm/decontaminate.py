"""Benchmark decontamination with a distributed positional inverted index.

Every window of ``size`` consecutive words of a benchmark item (the whole item when it is shorter)
is looked up by its rarest words. One pass counts the benchmark's words in all documents; the two
rarest words of each window, by that count, are its search terms. A second pass stores the postings
``(term, key, place)`` of all search terms in all documents, each with the words around it. Lists
are shifted by the term's offset in the window and intersected, rarest first, so that only places
where both terms stand right are compared with the whole window, on the words stored with the
posting. A proximity match holds every word of a window around its rarest term in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import stage
from .common import EMPTY_SHA, alnum_words, ascii_lower, small, text_of

SIZE = 13
BROADCAST_ROWS = 200_000


def _words(column):
    return alnum_words(ascii_lower(text_of(column)))


def windows(benchmark: DataFrame, size: int = SIZE, text: str = "text", item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Written tables ``(win, words)`` of distinct windows and ``(win, item)`` of their items."""
    items = benchmark.select(F.col(item).alias("item"), _words(text).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    # the words themselves name a window: no two windows can share a name
    each = stage(each.select("item", "words", F.array_join("words", " ").alias("win")), "windows")
    return each.select("win", "words").distinct(), each.select("win", "item").distinct()


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences ``(term, n)`` in all documents of each given term that occurs."""
    return docs.select(F.explode(_words(text)).alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, terms: DataFrame, around: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(term, key, pos, from, near)``: places of the terms from 0; ``near`` is the words from place ``from`` on, up to ``around`` on either side."""
    places = docs.select(F.col(key).alias("key"), _words(text).alias("w")).select("key", "w", F.posexplode("w").alias("pos", "term"))
    start = F.greatest(F.lit(0), F.col("pos") - around)
    return places.join(terms, "term").select(
        "term", "key", "pos", start.alias("from"), F.slice("w", start + 1, F.col("pos") - start + around + 1).alias("near")
    )


def matches(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, text: str = "text", key: str = "doc_id", item: str = "item_id"):
    """Written tables ``(key, start, len, win, exact)`` of matches and ``(win, item)``.

    Exact matches give the first word's place; proximity matches (``exact`` false) the place where the
    window would start by its rarest term.
    """
    wins, owners = windows(benchmark, size, text, item)
    wins = stage(wins, "distinct-windows")
    at = wins.select("win", "words", F.posexplode("words").alias("off", "term"))
    terms = stage(at.select("term").distinct(), "terms")
    counts = stage(term_counts(docs, small(terms, BROADCAST_ROWS), text), "counts")
    rarest = Window.partitionBy("win").orderBy("n", "off")
    # A word that no document holds rules its windows out; the inner join drops those words, and ``all`` their windows.
    found = at.join(counts, "term").withColumn("rank", F.row_number().over(rarest)).withColumn("all", F.count("*").over(Window.partitionBy("win")))
    search = stage(found.where((F.col("rank") <= 2) & (F.col("all") == F.size("words"))).drop("n", "all"), "search")
    # Every posting list that is needed, once; one row for each (term, place) of the collection.
    wanted = stage(search.select("term").distinct(), "wanted")
    index = stage(postings(docs, small(wanted, BROADCAST_ROWS), size - 1, text, key), "postings")
    first = small(search.where("rank = 1").select("term", "win", "words", "off"), BROADCAST_ROWS)
    second = small(search.where("rank = 2").select("term", "win", "off"), BROADCAST_ROWS)
    heads = index.join(first, "term").select(
        "key", "win", "words", (F.col("pos") - F.col("off")).alias("start"), "from", "near"
    )
    others = index.join(second, "term").select("key", "win", (F.col("pos") - F.col("off")).alias("start"), F.lit(True).alias("_both"))
    both = heads.join(others.distinct(), ["key", "win", "start"], "left")
    same = F.slice("near", F.greatest(F.lit(1), F.col("start") - F.col("from") + 1), F.size("words")) == F.col("words")
    exact = (F.col("start") >= F.col("from")) & (F.col("_both") | (F.size("words") == 1)) & same
    close = F.size(F.array_except("words", "near")) == 0
    out = both.withColumn("exact", F.coalesce(exact, F.lit(False))).where(F.col("exact") | close)
    return stage(out.select("key", "start", F.size("words").alias("len"), "win", "exact"), "matches"), owners


def report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, percent: int = 5, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """``(key, n_words, n_hit, n_items, items_sha256, contaminated, n_near)`` for each row of ``docs``.

    ``n_hit`` words lie inside an occurrence of a window; ``contaminated`` when they are at least
    ``percent`` of the words and one at least; ``n_near`` windows match by proximity alone. Null
    and empty texts have no words; items without words have no window. Rows that share a key are
    reported with the hits of all of them; a null key has none.
    """
    found, owners = matches(docs, benchmark, size, text, key, item)
    exact = found.where("exact")
    spans = exact.groupBy("key", "start").agg(F.max("len").alias("len"))
    before = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    spans = spans.withColumn("_seen", F.coalesce(F.max(end).over(before), F.lit(0)))
    hit = spans.groupBy("key").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "_seen"))).cast("long").alias("_hit"))
    items = exact.select("key", "win").distinct().join(owners, "win").select("key", "item").distinct()
    names = items.groupBy("key").agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("_items"))
    near = found.where("not exact").join(exact.select("key", "win").distinct(), ["key", "win"], "left_anti")
    near = near.groupBy("key").agg(F.count_distinct("win").alias("_near"))
    rows = docs.select(F.col(key).alias("key"), F.size(_words(text)).cast("long").alias("n_words"))
    n_hit = F.coalesce("_hit", F.lit(0)).cast("long")
    return (
        rows.join(hit, "key", "left").join(names, "key", "left").join(near, "key", "left")
        .select(
            F.col("key").alias(key), "n_words", n_hit.alias("n_hit"),
            F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce(F.sha2(F.array_join("_items", ",").cast("binary"), 256), F.lit(EMPTY_SHA)).alias("items_sha256"),
            ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * percent)).alias("contaminated"),
            F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with their own columns, that are not contaminated. Rows with a null key stay."""
    bad = report(docs, benchmark, key=key, text=text, **options).where("contaminated").select(F.col(key).alias("_bad")).distinct()
    return docs.join(bad, docs[key] == bad["_bad"], "left_anti")
