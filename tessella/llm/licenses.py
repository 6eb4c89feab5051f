"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

A block is one line of a text as a set of words. A template T is found in block B when
``100 * |T & B| >= threshold * |T|``. Template words are ordered by their frequency over all
blocks, rarest first; a qualifying block must hold one of the first
``|T| - ceil(threshold * |T|) + 1`` words of T (prefix filter), must have at least
``ceil(threshold * |T|)`` words (length filter), and its first match at place p of T leaves at most
``|T| - p`` matches (positional filter). The surviving pairs are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..runtime import stage
from .common import alnum_words, ascii_lower, let, small, text_of

#: The phrases whose places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices of common licenses.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work CC0"),
]
THRESHOLD = 90
BROADCAST_ROWS = 100_000


def words_of(text: Column) -> Column:
    return alnum_words(ascii_lower(text))


def templates(spark: SparkSession, rows=None) -> DataFrame:
    """``(template, label, text)``."""
    rows = TEMPLATES if rows is None else rows
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "template int, label string, text string")


def similar_blocks(docs: DataFrame, known: DataFrame, threshold: int = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, block, label, template, overlap, containment)`` for every block that contains a template.

    ``block`` is the line number from 0. Null and empty texts have no block, repeated rows
    repeat their matches, a template without words matches nothing, an empty side gives no rows.
    """
    t = stage(
        known.select("template", "label", F.array_distinct(words_of(text_of("text"))).alias("words"))
        .where(F.size("words") > 0).withColumn("need", F.ceil(F.size("words") * threshold / 100).cast("int")),
        "templates",
    )
    vocabulary = t.select(F.explode("words").alias("word")).distinct()
    vocabulary = small(stage(vocabulary, "vocabulary"), BROADCAST_ROWS)
    lines = docs.select(F.col(key).alias("_key"), F.posexplode(F.split(text_of(text), "\n")).alias("_block", "_line"))
    blocks = lines.select("_key", "_block", F.array_distinct(words_of(F.col("_line"))).alias("_words"))
    # corpus frequency of the template words, then their place in each template, rarest first
    counts = blocks.select(F.explode("_words").alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("template").orderBy(F.coalesce("n", F.lit(0)), "word")
    ranked = t.select("template", "need", F.size("words").alias("size"), F.explode("words").alias("word")).join(counts, "word", "left")
    ranked = ranked.withColumn("at", F.row_number().over(order) - 1)
    prefix = stage(ranked.where(F.col("at") <= F.col("size") - F.col("need")), "prefixes")
    prefix = small(prefix.select(F.col("word").alias("_word"), "template", "need", "size", "at"), BROADCAST_ROWS)
    # Only the word itself crosses to the join; the block goes along as its own word list.
    postings = blocks.select("_key", "_block", "_words", F.explode("_words").alias("_word"))
    pairs = postings.join(prefix, "_word").where(
        (F.size("_words") >= F.col("need")) & (F.col("size") - F.col("at") >= F.col("need"))
    )
    full = small(t.select("template", "label", F.col("words").alias("_template")), BROADCAST_ROWS)
    found = pairs.join(full, "template").withColumn("overlap", F.size(F.array_intersect("_words", "_template")))
    # a pair that meets in several prefix words is reported at the first of them
    first = F.col("at") == F.array_min(
        F.transform(F.array_intersect(F.col("_prefix"), F.col("_words")), lambda w: F.array_position(F.col("_prefix"), w) - 1)
    )
    heads = ranked.where(F.col("at") <= F.col("size") - F.col("need")).groupBy("template").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]).alias("_prefix")
    )
    heads = small(stage(heads, "heads"), BROADCAST_ROWS)
    return (
        found.where(F.col("overlap") >= F.col("need")).join(heads, "template").where(first)
        .select(
            F.col("_key").alias(key), F.col("_block").alias("block"), "label", "template", "overlap",
            (F.col("overlap") / F.col("size")).alias("containment"),
        )
    )


def phrase_places(words: Column, phrase: str) -> Column:
    """Start places of a phrase, from 0. Texts without it cost one substring search."""
    parts = phrase.split(" ")
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    at = lambda w: F.filter(
        F.sequence(F.lit(0), F.size(w) - 1),
        lambda i: F.forall(F.array(*(F.get(w, i + k) == p for k, p in enumerate(parts))), lambda x: F.coalesce(x, F.lit(False))),
    )
    return F.when(F.contains(joined, F.lit(f" {phrase} ")), let(words, at)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, known: DataFrame, phrases: dict[str, str] = PHRASES, threshold: int = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for each row.

    ``labels`` joins those of phrases and of templates; ``score`` is 1 with a phrase, else the best
    containment, else 0. Null and empty texts have no words and no labels. Rows that share a key
    share the labels that templates give; a null key gets none of these.
    """
    rows = docs.select(F.col(key).alias("_key"), words_of(text_of(text)).alias("_words"))
    places = {p: phrase_places(F.col("_words"), p) for p in phrases}
    rows = rows.select("_key", F.size("_words").cast("long").alias("n_words"), *(c.alias(f"_p{i}") for i, c in enumerate(places.values())))
    found = [F.col(f"_p{i}") for i in range(len(phrases))]
    base = F.array_compact(F.array(*(F.when(F.size(c) > 0, F.lit(label)) for c, label in zip(found, phrases.values()))))
    rows = rows.select("_key", "n_words", F.concat(*found).alias("_all"), F.array_sort(F.array_distinct(base)).alias("_base"))
    matches = similar_blocks(docs, known, threshold, text, key).groupBy(F.col(key).alias("_key")).agg(
        F.collect_set("label").alias("_labels"), F.max("containment").alias("_best")
    )
    joined = F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>")))), ",")
    return rows.join(matches, "_key", "left").select(
        F.col("_key").alias(key), "n_words", F.size("_all").cast("long").alias("n_base"),
        F.array_min("_all").cast("long").alias("first_word"), F.array_max("_all").cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"), joined.alias("labels"),
        F.when(F.size("_all") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
