"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.align import AlignParams, align_digest
from tidemark.llm.audit import audit_filters, audit_sql
from tidemark.llm.bayes import site_quality
from tidemark.llm.chat import CLOSE, chat_digest, digest_sql
from tidemark.llm.imatch import fingerprint_edits
from tidemark.llm.jaccard import JaccardParams, jaccard_digest
from tidemark.llm.mixing import mix_digest
from tidemark.llm.packing import PackParams, pack, pieces
from tidemark.llm.pii import detect_pii, pii_digest
from tidemark.llm.quality import quality_rules
from tidemark.llm.secrets import scan_secrets, secret_digest
from tidemark.llm.urls import ALLOW, BLOCK, Rule, judge_urls
from tidemark.llm.warc import derivative_digest

# Ranks of the vocabulary whose tokenizer file is byte_bpe_50k.json.
TOKENIZER = "byte_bpe_50k.tiktoken"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")

URL_RULES = (
    Rule(ALLOW, "com", "/"),
    Rule(BLOCK, "example.com", "/en/"),
    Rule(ALLOW, "www.example.com", "/en/"),
    Rule(BLOCK, "net", "/es/"),
    Rule(BLOCK, "net", "/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as training text, and one whose texts hold control strings."""
    trap = f"{CLOSE}[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(trap).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digest(rows.unionByName(added))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans and those the trained classifier adds."""
    return pii_digest(detect_pii(table(spark, sf_dir, "documents")))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mixture of sources takes, by weights 5, 2, 1."""
    return mix_digest(table(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into pieces and packed into sequences of 1024 tokens."""
    params = PackParams(tokenizer=public_tokenizers.path(TOKENIZER))
    return pack(pieces(table(spark, sf_dir, "documents"), params), params)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; a document's source owns it, its language is the repository."""
    return secret_digest(scan_secrets(table(spark, sf_dir, "documents")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page, by their links and digests."""
    return derivative_digest(table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a Jaccard index of at least 0.9 on three-word shingles."""
    return jaccard_digest(table(spark, sf_dir, "documents"), JaccardParams(words=3, percent=90))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, n-gram score and verdict of every document."""
    scored, name = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.col(f"{name}.*"))


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document given its source (as host) and language (as path inside it)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return site_quality(docs, labels, F.col("source"), F.col("lang"))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every document, and how common its links are."""
    first, second = map(public_tokenizers.path, ALIGNED)
    return align_digest(table(spark, sf_dir, "documents"), AlignParams(first, second))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source, in every order, and their shares by the potential."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every page's URL: its rule's, else that of trees trained on the URLs with a rule."""
    judged, name = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    verdict = F.col(name)
    return judged.select("page_id", *[verdict[c].alias(c) for c in ("host", "path", "rule", "verdict")])


QUERIES = {
    "op1_chat": op1_chat,
    "op2_pii": op2_pii,
    "op3_mix": op3_mix,
    "op4_pack": op4_pack,
    "op5_secrets": op5_secrets,
    "op6_warc": op6_warc,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_site_quality": op9_site_quality,
    "op10_imatch": op10_imatch,
    "op11_align": op11_align,
    "op12_filter_audit": op12_filter_audit,
    "op13_url_filter": op13_url_filter,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op1_chat": digest_sql(),
    "op12_filter_audit": audit_sql(),
}
