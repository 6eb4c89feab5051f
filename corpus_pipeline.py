"""Training-data pipeline over ``documents``: five stages, each written and read again.

Quality rules drop documents, repeated passages are cut out of texts, one document of each group of
near duplicates stays, documents with benchmark text go, and the rest gets mixing rates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from tessella.llm.common import spaced_words, table, text_of
from tessella.runtime import stage

#: Near duplicates: five-word shingles, similarity 0.8.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds; a document left without a word goes.

    Null and empty texts stay as they are. ``n_chars``, where there is one, follows the text; all other columns keep
    their values, also one that is called ``lines_removed``. An empty table stays empty.
    """
    spare = "lines_removed_"
    while spare in docs.columns:
        spare += "_"
    out = line_dedup.dedup(docs.withColumnRenamed("lines_removed", spare))
    changed = F.col("lines_removed") > 0
    out = out.where(~(changed & (F.size(spaced_words(text_of("text"))) == 0)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return out.select(*(F.col(spare if c == "lines_removed" else c).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id."""
    return ngram_join.one_of_each(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a rate above zero, with their rate and domain posteriors.

    The columns that the mix adds take the place of corpus columns of the same name. Null keys meet null
    keys, repeated rows keep one rate, an empty table stays empty.
    """
    found = stage(mixing.mix(docs, table(spark, sf_dir, "labels")), "rates").where("rate > 0")
    rest = docs.drop(*(c for c in found.columns if c != "doc_id"))
    return rest.join(found, rest["doc_id"].eqNullSafe(found["doc_id"])).drop(found["doc_id"])


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination), ("mixing", mix_domains),
]

#: SQL cannot express content-defined chunks, components or the fitted rates; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return stage(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
