"""Run records: one appended row per training run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "run_name string, started_at timestamp, params map<string,string>, metrics map<string,double>, model_path string"
)


def _map(values: Mapping, kind: str) -> Column:
    entries = [F.lit(part) for item in values.items() for part in item]
    return (F.create_map(*entries) if entries else F.create_map()).cast(kind)


def log_run(
    spark: SparkSession,
    path: str,
    run_name: str,
    params: Mapping[str, str],
    metrics: Mapping[str, float],
    model_path: str | None = None,
) -> None:
    """Append a run's parameters, metrics and model location to the runs table."""
    row = spark.range(1, numPartitions=1).select(
        F.lit(run_name).alias("run_name"),
        F.current_timestamp().alias("started_at"),
        _map(params, "map<string,string>").alias("params"),
        _map(metrics, "map<string,double>").alias("metrics"),
        F.lit(model_path).cast("string").alias("model_path"),
    )
    row.write.mode("append").parquet(path)


def scan_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)
