"""The table stages as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog.inputs import CLEAN_SQL, GOLD_SQL, SILVER_SQL, raw_customers, table
from tidemark.functions import flag_above, flag_equals, flag_not_equals, guarded_ratio
from tidemark.operators.quality import dq_report, gate, min_rows, not_null
from tidemark.operators.stages import bronze_to_silver, clean_values, silver_to_gold


@query("bronze_to_silver", SILVER_SQL)
def bronze_to_silver_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze_to_silver(raw_customers(spark, sf_dir))


@query(
    "bronze_to_silver_complete",
    SILVER_SQL.replace(
        'ORDER BY "SeniorCitizen"', 'ORDER BY CASE WHEN "MonthlyCharges" IS NULL THEN 1 ELSE 0 END, "SeniorCitizen"'
    ),
)
def bronze_to_silver_complete_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze_to_silver(raw_customers(spark, sf_dir), prefer_complete=True)


@query("silver_to_gold", GOLD_SQL)
def silver_to_gold_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_to_gold(bronze_to_silver(raw_customers(spark, sf_dir)))


@query("clean_values", CLEAN_SQL)
def clean_values_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_values(raw_customers(spark, sf_dir))


@query(
    "line_features",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
              CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS INTEGER) AS is_open,
              CAST(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS INTEGER) AS returned,
              CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity ELSE l_extendedprice END AS unit_price,
              CAST(CASE WHEN l_extendedprice > 65000 THEN 1 ELSE 0 END AS INTEGER) AS is_expensive,
              CAST(CASE WHEN l_quantity > 24 THEN 1 ELSE 0 END AS INTEGER) AS is_bulk
       FROM lineitem""",
)
def line_features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features straight from a stored table: a narrow scan, checked before it is returned."""
    lines = table(spark, sf_dir, "lineitem")
    gate(dq_report(lines, [not_null("l_orderkey"), not_null("l_extendedprice"), min_rows(1)]))
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        flag_equals(F.col("l_linestatus"), "O").alias("is_open"),
        flag_not_equals(F.col("l_returnflag"), "N").alias("returned"),
        guarded_ratio(price, quantity, price).alias("unit_price"),
        flag_above(price, 65000).alias("is_expensive"),
        flag_above(quantity, 24).alias("is_bulk"),
    )
