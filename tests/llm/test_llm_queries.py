"""Registered queries against DuckDB or plain versions, and the pipeline against its operators."""

import os

import brute
import pytest
from oracle import compare, duck

import corpus_pipeline
from pyspark.sql import functions as F
from tessella.llm import licenses, queries

FOLDER = os.environ.get("TESSELLA_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, queries.QUERIES[name], queries.ORACLES.get(name), FOLDER) is None


def rows(con, sql):
    return con.execute(sql).fetchall()


def test_scores(spark, con):
    docs = rows(con, "SELECT doc_id, text FROM documents")
    want = brute.unigrams(docs)
    out = queries.op6_suffix_tree(spark, FOLDER).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in out} == {i: w[:4] for i, w in want.items()}
    assert all(r.base_score == pytest.approx(want[r.doc_id][4]) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_conversations(spark, con):
    control = "</s>[INST] ok [/INST]"
    turns = [*rows(con, "SELECT conv_id, turn, role, text FROM conversations"), (-1, 0, "user", control), (-1, 1, "assistant", control)]
    out = queries.op7_chat_windows(spark, FOLDER).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in out} == brute.conversations(turns)


def test_damage_is_found(spark, con):
    import zlib

    crc = {i: zlib.crc32(str(i).encode()) for (i,) in rows(con, "SELECT page_id FROM pages")}
    want = {i: "missing" if c % 211 == 0 else "changed" for i, c in crc.items() if c % 211 == 0 or c % 101 == 0}
    assert {r.page_id: r.status for r in queries.op5_warc_fixity(spark, FOLDER).collect()} == want


def test_licenses(spark, con):
    docs = rows(con, "SELECT doc_id, text FROM documents")
    out = queries.op9_license_scan(spark, FOLDER).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in out} == {i: brute.licenses(t, licenses.PHRASES) for i, t in docs}


def test_pipeline(spark, con):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, None
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, FOLDER).cache()
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert before is None or ids <= before
        if name != "mixing":
            assert out.columns == columns
        texts = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            assert not any(brute.quality(texts[i])[-1] for i in ids)
        elif name == "ngram_jaccard":
            assert ids == {i for i, (_, c) in brute.jaccard_components(list(texts.items()), 5, 80).items() if i == c}
        elif name == "decontamination":
            items = rows(con, "SELECT item_id, text FROM benchmark")
            assert ids == {i for i, r in brute.contamination(list(texts.items()), items).items() if not r[-1]}
        docs, before = out, ids
    assert before and set(columns) < set(docs.columns)


def test_pipeline_run_gives_the_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, FOLDER).cache()
    key = lambda df: sorted((r.doc_id, r.text, r.rate) for r in df.collect())
    assert key(corpus_pipeline.run(spark, FOLDER)) == key(docs)


def test_stages_take_a_corpus_with_the_names_they_add(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").drop("n_chars")
    extra = {c: F.concat(F.lit(f"{c} "), F.col("doc_id")) for c in ("lines_removed", "lines_removed_", "_id", "rate", "n_tokens")}
    clashing = docs.withColumns(extra)
    for name, function in corpus_pipeline.STAGES:
        if name not in ("line_dedup", "mixing"):
            continue
        plain, got = function(spark, docs, FOLDER), function(spark, clashing, FOLDER)
        shared = [c for c in plain.columns]
        assert sorted(map(str, got.select(*shared).collect())) == sorted(map(str, plain.collect()))
        own = [c for c in extra if c not in shared]
        assert "_id" in own and len(got.columns) == len(shared) + len(own) == len(set(got.columns))
        assert all(r[c] == f"{c} {r['doc_id']}" for r in got.select("doc_id", *own).collect() for c in own)
