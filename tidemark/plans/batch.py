"""The batch run: raw file to silver, gold, model and run record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import GOLD_SCHEMA, SILVER_SCHEMA, JobConfig
from tidemark.operators.model import Trained, save_model, train_and_evaluate
from tidemark.operators.quality import dq_report, gate, gold_checks
from tidemark.operators.stages import bronze_to_silver, silver_to_gold
from tidemark.sources.runs import log_run
from tidemark.sources.tables import scan_csv, scan_table, write_overwrite


@dataclass(frozen=True)
class BatchResult:
    """Rows per layer, the checks' outcome, the model with its metrics, and where it is."""

    rows: dict[str, int]
    quality: list[dict]
    trained: Trained
    model_path: str


def build_silver(spark: SparkSession, config: JobConfig) -> DataFrame:
    """Clean the raw file and publish silver; the result reads the published files.

    The raw file is read and deduplicated once: later steps and counts use the stored
    table, so they all see the same surviving rows.
    """
    raw = scan_csv(spark, config.raw_path, infer=config.infer_schema)
    write_overwrite(bronze_to_silver(raw, config.prefer_complete), config.silver_path, config.table_format)
    return scan_table(spark, config.silver_path, config.table_format, SILVER_SCHEMA)


def build_gold(spark: SparkSession, config: JobConfig) -> tuple[DataFrame, list[dict]]:
    """Derive features and publish gold, unless a check fails: then the old table stays.

    The checks run on the plan before anything is written. They read three columns of
    silver, and gold is a projection of that stored table, so the write sees the same rows.
    """
    silver = scan_table(spark, config.silver_path, config.table_format, SILVER_SCHEMA)
    gold = silver_to_gold(silver, config.rules)
    quality = gate(dq_report(gold, gold_checks(config.min_rows)))
    write_overwrite(gold, config.gold_path, config.table_format)
    return scan_table(spark, config.gold_path, config.table_format, GOLD_SCHEMA), quality


def build_model(spark: SparkSession, config: JobConfig) -> tuple[Trained, str]:
    """Train on gold, save the model under a path of its own and record the run."""
    gold = scan_table(spark, config.gold_path, config.table_format, GOLD_SCHEMA)
    trained = train_and_evaluate(gold, config.model)
    path = save_model(trained.model, f"{config.model_path}/{trained.model.uid}")
    metrics = {} if trained.auc is None else {"auc_roc": trained.auc}
    log_run(spark, config.runs_path, config.run_name, config.model.logged(), metrics, path)
    return trained, path


def run_batch(spark: SparkSession, config: JobConfig) -> BatchResult:
    """All steps in order; an error in one stops the run, so no model is trained on old data."""
    silver = build_silver(spark, config)
    gold, quality = build_gold(spark, config)
    # Counts of the stored tables: they come from file footers, not from the plans.
    rows = {"silver": silver.count(), "gold": gold.count()}
    trained, path = build_model(spark, config)
    return BatchResult(rows, quality, trained, path)
