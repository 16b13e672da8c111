"""Messages to the append-only bronze event table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import EVENT_SCHEMA
from tidemark.operators.events import CORRUPT, parse_events
from tidemark.sources.streams import StreamSource, scan_stream

QUARANTINED = "quarantined"


class StreamTimeout(TimeoutError):
    """The stream did not drain its input in the time allowed."""


def stamp(df: DataFrame) -> DataFrame:
    """Add ``ingested_at``, one value per batch."""
    return df.withColumn("ingested_at", F.current_timestamp())


def bronze_events(messages: DataFrame, separate_corrupt: bool = True) -> DataFrame:
    """Parsed and stamped events; a narrow projection that works on batch and stream alike.

    With ``separate_corrupt`` a message that did not parse whole keeps its text and gets
    ``quarantined = 1``, the sink's partition column. Without it such a message is a row
    with nulls and its text is lost.
    """
    parsed = parse_events(messages, EVENT_SCHEMA, keep_corrupt=separate_corrupt)
    if separate_corrupt:
        parsed = parsed.withColumn(QUARANTINED, F.col(CORRUPT).isNotNull().cast("int"))
    return stamp(parsed)


def write_stream_append(
    df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", partition_by: str | None = None
) -> StreamingQuery:
    """Append all input that is there to a table, then stop.

    Progress is kept at ``checkpoint``, apart from the data. The file sink commits each
    batch once, so a restarted run neither repeats nor skips rows.
    """
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    return writer.trigger(availableNow=True).start(path)


def drain(query: StreamingQuery, timeout: float | None = None) -> StreamingQuery:
    """Wait for the end; a run that takes longer is stopped and reported."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise StreamTimeout(f"stream did not finish within {timeout} s; the next run continues from its checkpoint")
    return query


def stream_bronze(
    spark: SparkSession,
    source: StreamSource,
    path: str,
    checkpoint: str,
    separate_corrupt: bool = True,
    fmt: str = "parquet",
    timeout: float | None = None,
) -> StreamingQuery:
    """The whole stage: read, parse, stamp, append, stop. Stateless, so nothing is shuffled."""
    events = bronze_events(scan_stream(spark, source), separate_corrupt)
    partition_by = QUARANTINED if separate_corrupt else None
    return drain(write_stream_append(events, path, checkpoint, fmt, partition_by), timeout)


def last_batch(spark: SparkSession, checkpoint: str) -> int:
    """The number of the last finished batch of a stream, -1 before the first.

    Old numbers are removed from a checkpoint after a while, the last one never.
    """
    commits = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*")
    try:
        names = commits.load(f"{checkpoint}/commits").select(F.regexp_extract("path", "([0-9]+)$", 1).alias("n"))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return -1
        raise
    last = names.agg(F.max(F.col("n").cast("bigint")).alias("n")).first()["n"]
    return -1 if last is None else last


def _stored(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """The event table with its quarantine column, also before it has a row."""
    try:
        table = spark.read.format(fmt).load(path)
    except AnalysisException as error:
        # This error has no condition of its own.
        if "Unable to infer schema" not in str(error):
            raise
        added = [(CORRUPT, T.StringType()), ("ingested_at", T.TimestampType()), (QUARANTINED, T.IntegerType())]
        fields = [*EVENT_SCHEMA.fields, *[T.StructField(name, kind) for name, kind in added]]
        return spark.createDataFrame([], T.StructType(fields))
    if QUARANTINED not in table.columns:
        raise ValueError(f"{path} was written with separate_corrupt=False and has no quarantine: read it as a table")
    return table


def scan_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The events that parsed whole; the filter prunes the quarantined folder."""
    return _stored(spark, path, fmt).where(F.col(QUARANTINED) == 0).drop(QUARANTINED, CORRUPT)


def scan_quarantine(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The messages that did not, with their text."""
    return _stored(spark, path, fmt).where(F.col(QUARANTINED) == 1).drop(QUARANTINED)
