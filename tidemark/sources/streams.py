"""Streaming sources that deliver one message body per row in a ``value`` column."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import REQUEST_TIMEOUT_MS, SESSION_TIMEOUT_MS


# What a batch takes unless told otherwise, so that a first run over years of data, or one after a
# long pause, ends in steps that can be repeated alone.
FILES_PER_BATCH = 10_000
OFFSETS_PER_BATCH = 50_000_000


@dataclass(frozen=True)
class StreamSource:
    """A streaming format with its options; ``path`` for file sources."""

    fmt: str
    path: str | None = None
    # Not shown: the options of a topic hold its login.
    options: Mapping[str, str] = field(default_factory=dict, repr=False)


def text_source(
    path: str, files_per_batch: int | None = FILES_PER_BATCH, bytes_per_batch: int | None = None
) -> StreamSource:
    """New text files in a folder, one message per line.

    Either limit splits a large backlog into batches, so a failure repeats one of them only. One
    in bytes takes the place of one in files; without both a run is a single batch.
    """
    options = {}
    if bytes_per_batch is not None:
        options["maxBytesPerTrigger"] = str(bytes_per_batch)
    elif files_per_batch is not None:
        options["maxFilesPerTrigger"] = str(files_per_batch)
    return StreamSource("text", path, options)


def kafka_source(
    servers: str,
    topic: str,
    jaas_config: str,
    min_partitions: int | None = None,
    max_offsets_per_trigger: int | None = OFFSETS_PER_BATCH,
) -> StreamSource:
    """One topic over TLS with a SASL/PLAIN login, from its earliest messages.

    The start applies to the first run only; later runs continue from the checkpoint.
    ``min_partitions`` reads a topic of few partitions with more tasks, and
    ``max_offsets_per_trigger`` bounds a batch after a long pause (None: it does not). The login
    text is the caller's: nothing here stores it.
    """
    # The consumer's security, start and timeouts.
    options = {
        "kafka.bootstrap.servers": servers,
        "kafka.security.protocol": "SASL_SSL",
        "kafka.sasl.mechanism": "PLAIN",
        "kafka.sasl.jaas.config": jaas_config,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "kafka.request.timeout.ms": str(REQUEST_TIMEOUT_MS),
        "kafka.session.timeout.ms": str(SESSION_TIMEOUT_MS),
    }
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return StreamSource("kafka", options=options)


def scan_stream(spark: SparkSession, source: StreamSource) -> DataFrame:
    """The streaming frame; its connector must be on the class path."""
    reader = spark.readStream.format(source.fmt).options(**source.options)
    return reader.load() if source.path is None else reader.load(source.path)
