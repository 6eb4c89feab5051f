"""One query per operator over the test tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    chat, decontaminate, fixity, html_text, licenses, line_dedup, merkle_manifest, mixing, ngram_join, prefix_trie, quality, suffix_tree, toxicity,
)
from .common import table
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines_removed", F.length("text").cast("long").alias("n_chars"), "text")


def op3_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"))


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def damaged(records: DataFrame) -> DataFrame:
    """A replica with every 101st record changed in one byte and every 211th lost, by the CRC-32 of the key."""
    crc = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(1))
    changed = F.when(crc % 101 == 0, F.concat(F.expr("substring(data, 1, length(data) - 1)"), F.lit("?").cast("binary"))).otherwise(F.col("data"))
    return records.where(crc % 211 != 0).select("key", "offset", changed.alias("data"))


def op5_warc_fixity(spark: SparkSession, folder: str) -> DataFrame:
    records = fixity.archive(table(spark, folder, "pages"))
    return fixity.audit(records, damaged(records)).withColumnRenamed("key", "page_id")


def op6_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return suffix_tree.score(docs, suffix_tree.fit(docs.where(suffix_tree.is_training(F.col("doc_id")))))


def op7_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    fixed = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)
    return chat.digest(chat.windows(turns.unionByName(fixed)))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"), licenses.templates(spark))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, *toxicity.fit(docs, table(spark, folder, "labels")))


def tampered() -> dict:
    """A replica that lost the line breaks of every text whose key has an even CRC-32."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, folder, "documents"), tampered()).drop("proof_levels")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_line_dedup, op3_ngram_jaccard, op4_html_text, op5_warc_fixity, op6_suffix_tree,
    op7_chat_windows, op8_mixing, op9_license_scan, op10_decontamination,
    op11_toxicity, op12_merkle_manifest, op13_prefix_trie,
)}
