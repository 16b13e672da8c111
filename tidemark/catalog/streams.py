"""Streams: messages are written as text files, drained into a table and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog.inputs import ORDER_EVENTS_SQL, table
from tidemark.operators.events import encode_events, generate_events
from tidemark.plans.stream import StreamConfig, run_stream
from tidemark.session import scratch_path
from tidemark.sources.streams import scan_stream, text_source
from tidemark.streaming.bronze import drain, scan_events, scan_quarantine, stream_bronze, write_stream_append


def stage_messages(spark: SparkSession, sf_dir: str, path: str, keep: Column | None = None) -> None:
    """One event per order as JSON lines, added to the folder ``path``."""
    orders = table(spark, sf_dir, "orders")
    chosen = orders if keep is None else orders.where(keep)
    encode_events(generate_events(chosen, "o_orderkey", at=F.col("o_orderdate"))).write.mode("append").text(path)


@query("scan_stream", "SELECT props AS value FROM events")
def scan_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message bodies exactly as they were sent."""
    base = scratch_path(spark, "scan")
    table(spark, sf_dir, "events").select(F.col("props").alias("value")).write.text(f"{base}/in")
    messages = scan_stream(spark, text_source(f"{base}/in"))
    drain(write_stream_append(messages, f"{base}/out", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/out")


@query("write_stream_append", ORDER_EVENTS_SQL)
def write_stream_append_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with one checkpoint over the same input: the second adds nothing."""
    base = scratch_path(spark, "rerun")
    stage_messages(spark, sf_dir, f"{base}/in")
    for _ in range(2):
        stream_bronze(spark, text_source(f"{base}/in"), f"{base}/out", f"{base}/checkpoint")
    return scan_events(spark, f"{base}/out").drop("ingested_at")


@query("stream_available_now", ORDER_EVENTS_SQL)
def stream_available_now_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run drains input that takes several batches."""
    base = scratch_path(spark, "drain")
    stage_messages(spark, sf_dir, f"{base}/in", F.col("o_orderstatus") == "F")
    stage_messages(spark, sf_dir, f"{base}/in", F.col("o_orderstatus") != "F")
    source = text_source(f"{base}/in", files_per_batch=1)
    stream_bronze(spark, source, f"{base}/out", f"{base}/checkpoint")
    return scan_events(spark, f"{base}/out").drop("ingested_at")


@query("stream_append", ORDER_EVENTS_SQL)
def stream_append_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run appends what arrived since the last one and keeps the rows that are there."""
    base = scratch_path(spark, "append")
    for status in ("F", "O", "P"):
        stage_messages(spark, sf_dir, f"{base}/in", F.col("o_orderstatus") == status)
        stream_bronze(spark, text_source(f"{base}/in"), f"{base}/out", f"{base}/checkpoint")
    return scan_events(spark, f"{base}/out").drop("ingested_at")


@query(
    "stream_checkpoint",
    """SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS run, count(*) AS "rows"
       FROM orders GROUP BY 1""",
)
def stream_checkpoint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per run: with the progress kept apart from the data, a run sees only new input."""
    base = scratch_path(spark, "progress")
    for status in ("F", "O", "P"):
        stage_messages(spark, sf_dir, f"{base}/in", F.col("o_orderstatus") == status)
        # The second run of each round finds nothing new.
        for _ in range(2):
            stream_bronze(spark, text_source(f"{base}/in"), f"{base}/out", f"{base}/checkpoint")
    # A run drains its input in one batch here, and a batch has one stamp: three rows to number.
    per_run = spark.read.parquet(f"{base}/out").groupBy("ingested_at").agg(F.count(F.lit(1)).alias("rows"))
    return per_run.select(F.row_number().over(Window.orderBy("ingested_at")).alias("run"), "rows")


_BAD = "event_type = 'error'"
_MIXED_SQL = """
SELECT CASE WHEN event_type = 'error' THEN NULL ELSE printf('CUST-%05d', user_id) END AS customer_id,
       CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS contract,
       CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END AS monthly_charges,
       CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS INTEGER) END AS tenure_months
FROM events
"""


def stage_mixed(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Messages of which one event type is no JSON and another has a field of the wrong type."""
    events = table(spark, sf_dir, "events")
    common = [
        F.format_string("CUST-%05d", F.col("user_id")).alias("customer_id"),
        F.col("event_type").alias("contract"),
        F.col("user_id").alias("tenure_months"),
        F.lit("x").alias("unknown"),
    ]
    good = F.to_json(F.struct(*common, F.col("value").alias("monthly_charges")))
    wrong_type = F.to_json(F.struct(*common, F.col("value").cast("string").alias("monthly_charges")))
    body = (
        F.when(F.expr(_BAD), F.concat(F.lit("not json "), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "view", wrong_type)
        .otherwise(good)
    )
    events.select(body.alias("value")).write.text(path)


def drained_mixed(spark: SparkSession, sf_dir: str, separate_corrupt: bool) -> str:
    base = scratch_path(spark, "bronze")
    stage_mixed(spark, sf_dir, f"{base}/in")
    source = text_source(f"{base}/in")
    stream_bronze(spark, source, f"{base}/out", f"{base}/checkpoint", separate_corrupt)
    return f"{base}/out"


_MIXED_COLUMNS = ["customer_id", "contract", "monthly_charges", "tenure_months"]


@query("stream_bronze", f"SELECT * FROM ({_MIXED_SQL}) AS m WHERE monthly_charges IS NOT NULL")
def stream_bronze_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that parsed whole."""
    return scan_events(spark, drained_mixed(spark, sf_dir, True)).select(*_MIXED_COLUMNS)


@query("stream_bronze_all_rows", _MIXED_SQL)
def stream_bronze_all_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message as a row, with nulls for what did not parse."""
    return spark.read.parquet(drained_mixed(spark, sf_dir, False)).select(*_MIXED_COLUMNS)


@query(
    "stream_quarantine",
    """SELECT CASE WHEN event_type = 'error' THEN 'not json ' || event_id
                   ELSE '{"customer_id":"' || printf('CUST-%05d', user_id) || '","contract":"view","tenure_months":'
                        || user_id || ',"unknown":"x","monthly_charges":"' || value || '"}' END AS message
       FROM events WHERE event_type IN ('error', 'view')""",
)
def stream_quarantine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept text of every message that did not parse whole."""
    kept = scan_quarantine(spark, drained_mixed(spark, sf_dir, True))
    return kept.select(F.col("_corrupt_record").alias("message"))


@query("run_stream", ORDER_EVENTS_SQL)
def run_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "stream")
    stage_messages(spark, sf_dir, f"{base}/in")
    run_stream(spark, StreamConfig(text_source(f"{base}/in"), f"{base}/out", f"{base}/checkpoint"))
    return scan_events(spark, f"{base}/out").drop("ingested_at")


@query("run_stream_batches", "SELECT true AS batch_per_file, CAST(0 AS BIGINT) AS batches_again")
def run_stream_batches_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a run that takes one file at a time, against the files, and of a run after it."""
    base = scratch_path(spark, "batches")
    for status in ("F", "O", "P"):
        stage_messages(spark, sf_dir, f"{base}/in", F.col("o_orderstatus") == status)
    files = spark.read.format("binaryFile").load(f"{base}/in").select("path").count()
    config = StreamConfig(text_source(f"{base}/in", files_per_batch=1), f"{base}/out", f"{base}/checkpoint")
    batches, again = run_stream(spark, config), run_stream(spark, config)
    return spark.range(1).select(
        F.lit(batches == files).alias("batch_per_file"), F.lit(again).cast("bigint").alias("batches_again")
    )
