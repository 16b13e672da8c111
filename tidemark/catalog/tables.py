"""Sources and sinks: tables are written to a scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog.inputs import GOLD_SQL, RAW_SQL, SILVER_SQL, raw_customers, table
from tidemark.config import GOLD_SCHEMA, MIN_ROWS, SILVER_SCHEMA, JobConfig, ModelParams
from tidemark.operators.metrics import auc_roc
from tidemark.operators.stages import bronze_to_silver, silver_to_gold
from tidemark.plans.batch import build_gold, build_silver
from tidemark.session import scratch_path
from tidemark.sources.runs import log_run, scan_runs
from tidemark.sources.tables import inspect_schema, scan_csv, scan_table, write_overwrite

_ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query("scan_csv", f"SELECT {_ORDER_COLUMNS} FROM orders")
def scan_csv_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(*_ORDER_COLUMNS.split(", "))
    path = scratch_path(spark, "orders-csv")
    orders.write.option("header", True).csv(path)
    return scan_csv(spark, path, schema=orders.schema)


@query("scan_csv_inferred", f"SELECT {_ORDER_COLUMNS} FROM orders")
def scan_csv_inferred_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(*_ORDER_COLUMNS.split(", "))
    path = scratch_path(spark, "orders-csv")
    orders.write.option("header", True).csv(path)
    inferred = scan_csv(spark, path, infer=True)
    kinds = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderdate": "timestamp_ntz"}
    return inferred.withColumns({name: F.col(name).cast(kind) for name, kind in kinds.items()})


@query("scan_table", SILVER_SQL)
def scan_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "silver")
    write_overwrite(bronze_to_silver(raw_customers(spark, sf_dir)), path)
    return scan_table(spark, path, contract=SILVER_SCHEMA)


@query("write_overwrite", GOLD_SQL)
def write_overwrite_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second write replaces the first, and is derived from the table it replaces."""
    path = scratch_path(spark, "gold")
    write_overwrite(bronze_to_silver(raw_customers(spark, sf_dir)), path)
    write_overwrite(silver_to_gold(scan_table(spark, path)), path)
    return scan_table(spark, path, contract=GOLD_SCHEMA)


@query(
    "inspect_schema",
    """SELECT CAST(c.ordinal_position AS INTEGER) AS "position", c.column_name,
              CASE c.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
                   WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS data_type,
              n.row_count
       FROM (SELECT row_number() OVER () AS ordinal_position, column_name, column_type AS data_type
             FROM (DESCRIBE SELECT * FROM lineitem)) AS c,
            (SELECT count(*) AS row_count FROM lineitem) AS n""",
)
def inspect_schema_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect_schema(table(spark, sf_dir, "lineitem"))


@query(
    "log_run",
    """SELECT 'gradient-boosting-v1' AS run_name, '100' AS n_estimators, '0.1' AS learning_rate, '4' AS max_depth,
              CAST(sum(CASE WHEN event_type = 'purchase' THEN 2 * below + ties ELSE 0 END) AS DOUBLE)
              / CAST(2 * count(*) FILTER (WHERE event_type = 'purchase')
                     * count(*) FILTER (WHERE event_type <> 'purchase') AS DOUBLE) AS auc_roc
       FROM (SELECT event_type,
                    count(*) FILTER (WHERE event_type <> 'purchase') OVER (ORDER BY value
                      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                    - count(*) FILTER (WHERE event_type <> 'purchase') OVER (PARTITION BY value) AS below,
                    count(*) FILTER (WHERE event_type <> 'purchase') OVER (PARTITION BY value) AS ties
             FROM events) AS ranked""",
)
def log_run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric of the events table, recorded and read back."""
    events = table(spark, sf_dir, "events")
    auc = auc_roc(events, "value", "event_type", "purchase").first()["auc_roc"]
    path = scratch_path(spark, "runs")
    log_run(spark, path, JobConfig.run_name, ModelParams().logged(), {"auc_roc": auc})
    params, metrics = F.col("params"), F.col("metrics")
    return scan_runs(spark, path).select(
        "run_name",
        *[params[name].alias(name) for name in ("n_estimators", "learning_rate", "max_depth")],
        metrics["auc_roc"].alias("auc_roc"),
    )


@query("build_gold", GOLD_SQL)
def build_gold_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch run up to gold: raw file, silver table, checks, gold table."""
    config = staged_batch(spark, sf_dir)
    build_silver(spark, config)
    return build_gold(spark, config)[0]


def staged_batch(spark: SparkSession, sf_dir: str) -> JobConfig:
    """The raw customer rows as a CSV folder, and a config for a run over it."""
    base = scratch_path(spark, "batch")
    raw = raw_customers(spark, sf_dir)
    raw_path = f"{base}/raw"
    # Spaces-only fields must survive the round trip; a null is written as an empty field.
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(raw_path)
    return JobConfig.under(base, raw_path, min_rows=least_rows(raw))


def least_rows(raw: DataFrame) -> int:
    """The row gate for a raw table: half of its customers, at most the usual gate."""
    customers = raw.agg(F.count_distinct("customerID").alias("n")).first()["n"]
    return min(MIN_ROWS, max(1, customers // 2))


@query("scan_csv_raw", RAW_SQL)
def scan_csv_raw_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw customer file as text columns, with the names from its header."""
    return scan_csv(spark, staged_batch(spark, sf_dir).raw_path)
