"""Quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.catalog import query
from tidemark.catalog.inputs import CLEAN_SQL, GOLD_SQL, raw_customers, table
from tidemark.operators.counts import duplicate_keys
from tidemark.operators.quality import dq_report, gold_checks, in_set, min_rows, not_null, unique
from tidemark.operators.stages import bronze_to_silver, clean_values, silver_to_gold


def report_line(check: str, column: str | None, observed: str, expected: str, operator: str, source: str) -> str:
    """One line of a report as SQL."""
    name = "CAST(NULL AS VARCHAR)" if column is None else f"'{column}'"
    return f"""SELECT '{check}' AS "check", {name} AS "column", CAST({observed} AS BIGINT) AS observed,
       CAST({expected} AS BIGINT) AS expected, {observed} {operator} {expected} AS passed FROM {source}"""


def not_null_sql(column: str, source: str) -> str:
    return report_line("not_null", column, f'count(*) FILTER (WHERE "{column}" IS NULL)', "0", "=", source)


def unique_sql(column: str, source: str) -> str:
    keys = f'(count(DISTINCT "{column}") + coalesce(max(CASE WHEN "{column}" IS NULL THEN 1 ELSE 0 END), 0))'
    return report_line("unique", column, keys, "count(*)", "=", source)


def in_set_sql(column: str, values: str, source: str) -> str:
    return report_line("in_set", column, f'count(*) FILTER (WHERE "{column}" NOT IN ({values}))', "0", "=", source)


def min_rows_sql(n: int, source: str) -> str:
    return report_line("min_rows", None, "count(*)", str(n), ">=", source)


_CLEAN = f"({CLEAN_SQL}) AS clean"
_GOLD = f"({GOLD_SQL}) AS gold"


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_values(raw_customers(spark, sf_dir))


@query(
    "dq_not_null",
    " UNION ALL ".join(not_null_sql(c, _CLEAN) for c in ("customerID", "MonthlyCharges", "Churn")),
)
def dq_not_null_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dq_report(_clean(spark, sf_dir), [not_null(c) for c in ("customerID", "MonthlyCharges", "Churn")])


@query("dq_unique", unique_sql("event_id", "events"))
def dq_unique_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dq_report(table(spark, sf_dir, "events"), [unique("event_id")])


@query("dq_unique_violated", unique_sql("customerID", _CLEAN))
def dq_unique_violated_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dq_report(_clean(spark, sf_dir), [unique("customerID")])


@query(
    "duplicate_keys",
    """SELECT l_orderkey, count(*) AS "rows" FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""",
)
def duplicate_keys_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("dq_in_set", in_set_sql("event_type", "'click', 'view'", "events"))
def dq_in_set_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dq_report(table(spark, sf_dir, "events"), [in_set("event_type", ("click", "view"))])


@query("dq_min_rows", min_rows_sql(5000, "events"))
def dq_min_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dq_report(table(spark, sf_dir, "events"), [min_rows(5000)])


@query(
    "dq_report",
    " UNION ALL ".join(
        [
            not_null_sql("customer_id", _GOLD),
            not_null_sql("monthly_charges", _GOLD),
            not_null_sql("churn", _GOLD),
            unique_sql("customer_id", _GOLD),
            in_set_sql("churn", "0, 1", _GOLD),
            min_rows_sql(5000, _GOLD),
        ]
    ),
)
def dq_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = silver_to_gold(bronze_to_silver(raw_customers(spark, sf_dir)))
    return dq_report(gold, gold_checks())
