import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.operators.sizing import store

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    columns, before = docs.columns, docs
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF_DIR))
        after[name] = docs
        if name != "packing":
            assert docs.columns == columns
    kept = {r.doc_id for r in after["quality_rules"].select("doc_id").collect()}
    good = labels.where("quality = 1 AND toxic = 0").join(before, "doc_id")
    long_ = good.where(F.size(F.split(F.trim("text"), r"\s+")) >= 60)
    assert {r.doc_id for r in long_.select("doc_id").collect()} <= kept
    distinct = [r.doc_id for r in after["jaccard_join"].select("doc_id").collect()]
    assert len(distinct) == len(set(distinct)) and set(distinct) <= kept
    clean = after["secret_scan"]
    assert sorted(r.doc_id for r in clean.select("doc_id").collect()) == sorted(distinct)
    assert clean.where(F.col("text").rlike("[0-9a-f]{16,}|AKIA[A-Z0-9]{14,}")).count() == 0
    assert clean.where(F.col("n_chars") != F.length("text")).count() == 0
    mixed = after["source_mix"].groupBy("doc_id").count().collect()
    assert {r.doc_id for r in mixed} <= set(distinct) and max(r["count"] for r in mixed) <= 3
    assert after["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    pieces = after["packing"].where("piece = 0").count()
    assert pieces == after["source_mix"].count()


def test_stages_take_odd_documents(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", "kept", "spans", "size")
    for _, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, SF_DIR)
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
        assert out.count() > 0


def test_all_stages_over_odd_documents(spark, odd):
    """Nulls, empty, long and repeated texts and clashing names through the whole pipeline, the first stage included."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(*names).limit(60)
    docs = odd.select(*names, "kept", "spans", "size").unionByName(given, allowMissingColumns=True)
    short = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")) < 50
    expected = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
        docs = store(stage(spark, docs, SF_DIR))
        if name != "packing":
            assert docs.columns == expected and docs.where(short).count() == 0
        # One word four thousand times over is no document, and nothing but the given ones is left.
        assert docs.where("doc_id IS NULL OR doc_id = 10 AND lang = 'la'" if name != "packing" else "doc_id IS NULL").isEmpty()
        assert docs.count() > 0
