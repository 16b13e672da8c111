"""Inputs of the registered queries, derived from the given tables.

The raw customer table is made from ``lineitem``: one raw row per line, the order number as
the key. Keys repeat (about four rows each, with differing values), some are null, and the
text columns hold blanks, other spellings and text that is no number. The expressions are
written in the dialect both engines share, so the same text also builds the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_EXPRESSIONS = {
    "customerID": "CASE WHEN l_discount = 0.1 AND l_tax = 0.0 THEN NULL ELSE CAST(l_orderkey AS STRING) END",
    "SeniorCitizen": "CASE WHEN l_linenumber = 7 THEN '1' WHEN l_tax = 0.08 THEN NULL ELSE '0' END",
    "tenure": (
        "CASE WHEN l_tax = 0.05 AND l_discount = 0.02 THEN NULL ELSE CAST(CAST(l_quantity AS INT) - 1 AS STRING) END"
    ),
    "PhoneService": "CASE WHEN l_linestatus = 'O' THEN 'Yes' WHEN l_tax = 0.02 THEN 'yes' ELSE 'No' END",
    "InternetService": (
        "CASE WHEN l_tax = 0.07 AND l_discount = 0.03 THEN NULL WHEN l_returnflag = 'N' THEN 'No' "
        "WHEN l_returnflag = 'R' THEN 'Fiber optic' ELSE 'DSL' END"
    ),
    "Contract": (
        "CASE WHEN l_linenumber <= 3 THEN 'Month-to-month' WHEN l_linenumber <= 5 THEN 'One year' ELSE 'Two year' END"
    ),
    "MonthlyCharges": (
        "CASE WHEN l_tax = 0.06 AND l_discount = 0.08 THEN NULL "
        "ELSE CAST(CAST(floor(l_extendedprice / 1000) AS INT) AS STRING) END"
    ),
    "TotalCharges": (
        "CASE WHEN l_discount = 0.05 THEN ' ' WHEN l_discount = 0.07 AND l_tax = 0.01 THEN 'abc' "
        "ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) END"
    ),
    "Churn": (
        "CASE WHEN l_linenumber <= 3 AND l_extendedprice > 40000 THEN 'Yes' WHEN l_tax = 0.03 THEN 'YES' "
        "WHEN l_tax = 0.04 THEN ' Yes' WHEN l_tax = 0.01 THEN NULL ELSE 'No' END"
    ),
    "PaymentMethod": "CASE WHEN l_discount < 0.04 THEN 'Mailed check' ELSE 'Credit card' END",
}

# The raw rows after cleaning, as a SQL table expression; the Spark side runs the stage code.
RAW_SQL = "SELECT " + ", ".join(f'{e} AS "{name}"' for name, e in RAW_EXPRESSIONS.items()) + " FROM lineitem"

CLEAN_SQL = f"""
SELECT "customerID",
       CAST(trunc(TRY_CAST("SeniorCitizen" AS DOUBLE)) AS INTEGER) AS "SeniorCitizen",
       CAST(trunc(TRY_CAST("tenure" AS DOUBLE)) AS INTEGER) AS "tenure",
       "PhoneService", "InternetService", "Contract",
       TRY_CAST("MonthlyCharges" AS DOUBLE) AS "MonthlyCharges",
       TRY_CAST(CASE WHEN trim("TotalCharges") = '' THEN NULL ELSE "TotalCharges" END AS DOUBLE) AS "TotalCharges",
       CAST(CASE WHEN lower("Churn") = 'yes' THEN 1 ELSE 0 END AS INTEGER) AS "Churn",
       "PaymentMethod"
FROM ({RAW_SQL}) AS raw
"""

SILVER_SQL = f"""
SELECT "customerID" AS customer_id, "SeniorCitizen" AS senior_citizen, "tenure" AS tenure,
       "PhoneService" AS phone_service, "InternetService" AS internet_service, "Contract" AS contract,
       "MonthlyCharges" AS monthly_charges, "TotalCharges" AS total_charges, "Churn" AS churn, "PaymentMethod"
FROM (
  SELECT *, row_number() OVER (
    PARTITION BY "customerID"
    ORDER BY "SeniorCitizen" NULLS FIRST, "tenure" NULLS FIRST, "PhoneService" NULLS FIRST,
             "InternetService" NULLS FIRST, "Contract" NULLS FIRST, "MonthlyCharges" NULLS FIRST,
             "TotalCharges" NULLS FIRST, "Churn" NULLS FIRST, "PaymentMethod" NULLS FIRST
  ) AS copy
  FROM ({CLEAN_SQL}) AS clean
) AS copies
WHERE copy = 1 AND "customerID" IS NOT NULL AND "MonthlyCharges" IS NOT NULL
"""

GOLD_SQL = f"""
SELECT customer_id, senior_citizen, tenure, monthly_charges, total_charges, contract, internet_service,
       CAST(CASE WHEN phone_service = 'Yes' THEN 1 ELSE 0 END AS INTEGER) AS has_phone_service,
       CAST(CASE WHEN internet_service <> 'No' THEN 1 ELSE 0 END AS INTEGER) AS has_internet,
       CAST(CASE WHEN contract = 'Month-to-month' THEN 1 ELSE 0 END AS INTEGER) AS is_month_to_month,
       CAST(CASE WHEN contract = 'Two year' THEN 1 ELSE 0 END AS INTEGER) AS is_long_term,
       CASE WHEN tenure > 0 THEN total_charges / tenure ELSE monthly_charges END AS charges_per_month_tenure,
       CAST(CASE WHEN monthly_charges > 65 THEN 1 ELSE 0 END AS INTEGER) AS high_monthly_charges,
       CAST(CASE WHEN tenure > 24 THEN 1 ELSE 0 END AS INTEGER) AS long_tenure,
       churn
FROM ({SILVER_SQL}) AS silver
"""

# One synthetic event per order, as SQL: the fields are cut from one hash of the order number.
_DIGEST = "sha256('42:' || CAST(o_orderkey AS VARCHAR))"


def _draw(i: int, bound: int) -> str:
    return f"((CAST(('0x' || substr(digest, {1 + 8 * i}, 8)) AS BIGINT) * {bound}) >> 32)"


ORDER_EVENTS_SQL = f"""
SELECT printf('CUST-%05d', o_orderkey) AS customer_id,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS "timestamp",
       list_extract(['DSL', 'Fiber optic', 'No'], {_draw(0, 3)} + 1) AS internet_service,
       list_extract(['Month-to-month', 'One year', 'Two year'], {_draw(1, 3)} + 1) AS contract,
       list_extract(['Electronic check', 'Mailed check', 'Bank transfer', 'Credit card'], {_draw(2, 4)} + 1)
         AS payment_method,
       ({_draw(3, 10001)} + 2000) / 100.0::DOUBLE AS monthly_charges,
       CAST({_draw(4, 72)} + 1 AS INTEGER) AS tenure_months,
       CAST({_draw(5, 11)} AS INTEGER) AS support_calls,
       CAST({_draw(6, 6)} AS INTEGER) AS late_payments
FROM (SELECT *, {_DIGEST} AS digest FROM orders) AS o
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw customer rows, all columns text, as a file with a header would give them."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS `{name}`" for name, e in RAW_EXPRESSIONS.items()])
