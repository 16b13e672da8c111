"""The streaming run, independent of the batch run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from tidemark.sources.streams import StreamSource
from tidemark.streaming.bronze import last_batch, stream_bronze


@dataclass(frozen=True)
class StreamConfig:
    source: StreamSource
    path: str
    checkpoint: str
    separate_corrupt: bool = True
    table_format: str = "parquet"
    timeout: float | None = None


def run_stream(spark: SparkSession, config: StreamConfig) -> int:
    """Drain the source into the event table; returns the number of batches run.

    Batches are numbered in the checkpoint, so the count holds however many there are.
    """
    before = last_batch(spark, config.checkpoint)
    stream_bronze(
        spark,
        config.source,
        config.path,
        config.checkpoint,
        config.separate_corrupt,
        config.table_format,
        config.timeout,
    )
    return last_batch(spark, config.checkpoint) - before
