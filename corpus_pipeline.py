"""A corpus from raw documents to packed sequences, one stage after the other.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table, which is written and read again
as the next one's documents. All but the last keep the documents' columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.jaccard import JaccardParams, keep_one
from tidemark.llm.mixing import mix
from tidemark.llm.packing import PackParams, pack, pieces
from tidemark.llm.quality import quality_rules
from tidemark.llm.secrets import redact_secrets
from tidemark.operators.sizing import store
from tidemark.session import run_scratch, scratch_path

TOKENIZER = "byte_bpe_50k.tiktoken"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects."""
    scored, name = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col(name)["kept"]).drop(name)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity of 0.8 or more.

    The search stores more than its result holds, and that goes before the next stage starts.
    """
    path = scratch_path(spark, "distinct")
    with run_scratch(spark):
        keep_one(docs, JaccardParams(words=5, percent=80)).write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return redact_secrets(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it."""
    return mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a sequence, and their token ids."""
    params = PackParams(tokenizer=public_tokenizers.path(TOKENIZER))
    return pack(pieces(docs, params, with_ids=True), params)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good_documents),
    ("jaccard_join", distinct_documents),
    ("secret_scan", clean_documents),
    ("source_mix", mixed_documents),
    ("packing", packed_sequences),
]

# Hashes, links and packing have no SQL here; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
