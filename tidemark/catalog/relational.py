"""Projections, filters, deduplication, counts and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog.inputs import CLEAN_SQL, GOLD_SQL, RAW_SQL, raw_customers, table
from tidemark.functions import (
    blank_to_double,
    flag,
    flag_above,
    flag_equals,
    flag_not_equals,
    format_customer_id,
    guarded_ratio,
    iso_utc,
    parse_iso,
    round_cents,
    to_double,
    to_int,
    yes_flag,
)
from tidemark.operators.counts import distinct_count, null_counts, row_count
from tidemark.operators.encode import label_encode
from tidemark.operators.model import fill_zero
from tidemark.operators.rows import dedup_key, derive, drop_null_rows, flatten_struct, project, rename
from tidemark.operators.stages import bronze_to_silver, clean_values, silver_to_gold
from tidemark.streaming.bronze import stamp


@query("project", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def project_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])


@query(
    "derive",
    """SELECT o_orderkey, o_orderpriority, lower(o_orderstatus) AS o_orderstatus,
              o_totalprice / 100 AS price_hundreds,
              CAST(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS INTEGER) AS is_large
       FROM orders""",
)
def derive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = derive(
        table(spark, sf_dir, "orders"),
        {
            "o_orderstatus": F.lower("o_orderstatus"),
            "price_hundreds": F.col("o_totalprice") / 100,
            "is_large": flag_above(F.col("o_totalprice"), 250000),
        },
    )
    return project(derived, ["o_orderkey", "o_orderpriority", "o_orderstatus", "price_hundreds", "is_large"])


@query(
    "rename",
    """SELECT c_custkey AS customer_id, c_name AS customer_name, c_nationkey, c_acctbal, c_mktsegment AS segment
       FROM customer""",
)
def rename_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"c_custkey": "customer_id", "c_name": "customer_name", "c_mktsegment": "segment"}
    return rename(table(spark, sf_dir, "customer"), names)


@query("flatten_struct", "SELECT event_id, event_type, value FROM events")
def flatten_struct_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "events").select(F.struct("event_id", "event_type", "value").alias("data"))
    return flatten_struct(nested, "data")


@query(
    "cast_types",
    f"""SELECT "customerID", "SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"
        FROM ({CLEAN_SQL}) AS clean""",
)
def cast_types_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_customers(spark, sf_dir)
    return raw.select(
        F.col("customerID").cast("string").alias("customerID"),
        to_int(F.col("SeniorCitizen")).alias("SeniorCitizen"),
        to_int(F.col("tenure")).alias("tenure"),
        to_double(F.col("MonthlyCharges")).alias("MonthlyCharges"),
        to_double(F.col("TotalCharges")).alias("TotalCharges"),
    )


@query(
    "drop_null_rows",
    f"""SELECT * FROM ({CLEAN_SQL}) AS clean
        WHERE "customerID" IS NOT NULL AND "MonthlyCharges" IS NOT NULL""",
)
def drop_null_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_null_rows(clean_values(raw_customers(spark, sf_dir)), ["customerID", "MonthlyCharges"])


@query("filter_null", f"""SELECT * FROM ({CLEAN_SQL}) AS clean WHERE "TotalCharges" IS NULL""")
def filter_null_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_values(raw_customers(spark, sf_dir)).where(F.col("TotalCharges").isNull())


@query("filter_not_in", "SELECT event_id, event_type, value FROM events WHERE event_type NOT IN ('click', 'view')")
def filter_not_in_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return events.where(~F.col("event_type").isin("click", "view"))


@query(
    "compare",
    """SELECT l_orderkey, l_linenumber, l_returnflag = 'N' AS is_equal, l_returnflag <> 'N' AS is_different,
              l_quantity > 24 AS is_above
       FROM lineitem""",
)
def compare_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_returnflag") == "N").alias("is_equal"),
        (F.col("l_returnflag") != "N").alias("is_different"),
        (F.col("l_quantity") > 24).alias("is_above"),
    )


@query(
    "case_when",
    f"""SELECT "customerID",
              CAST(CASE WHEN "InternetService" <> 'No' THEN 1 ELSE 0 END AS INTEGER) AS null_takes_else,
              CASE WHEN trim("TotalCharges") = '' THEN 'blank' WHEN "TotalCharges" = 'abc' THEN 'text'
                   ELSE 'number' END AS kind
       FROM ({RAW_SQL}) AS raw""",
)
def case_when_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.col("TotalCharges")
    kind = F.when(F.trim(total) == "", "blank").when(total == "abc", "text").otherwise("number")
    return raw_customers(spark, sf_dir).select(
        "customerID",
        F.when(F.col("InternetService") != "No", 1).otherwise(0).alias("null_takes_else"),
        kind.alias("kind"),
    )


_LINE_KEYED = """SELECT NULLIF(l_orderkey, 7) AS l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
       CASE WHEN l_tax = 0.06 THEN NULL ELSE l_extendedprice END AS l_extendedprice, l_returnflag, l_shipdate
FROM lineitem"""

_LINE_DEDUP = f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag,
       l_shipdate
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_linenumber NULLS FIRST, l_quantity NULLS FIRST,
                 l_extendedprice NULLS FIRST, l_returnflag NULLS FIRST, l_shipdate NULLS FIRST) AS copy
      FROM ({_LINE_KEYED}) AS keyed) AS copies
WHERE copy = 1"""


@query("dedup_key", _LINE_DEDUP)
def dedup_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "lineitem").select(
        F.nullif(F.col("l_orderkey"), F.lit(7)).alias("l_orderkey"),
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        F.when(F.col("l_tax") == 0.06, None).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_returnflag",
        "l_shipdate",
    )
    return dedup_key(keyed, "l_orderkey")


@query("row_count", 'SELECT count(*) AS "rows" FROM lineitem')
def row_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_count(table(spark, sf_dir, "lineitem"))


@query(
    "distinct_count",
    f"""SELECT count(*) AS distinct_values FROM (SELECT DISTINCT "customerID" FROM ({RAW_SQL}) AS raw) AS keys""",
)
def distinct_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_count(raw_customers(spark, sf_dir), "customerID")


@query(
    "null_counts",
    f"""SELECT count(*) FILTER (WHERE "customerID" IS NULL) AS "customerID",
               count(*) FILTER (WHERE "MonthlyCharges" IS NULL) AS "MonthlyCharges",
               count(*) FILTER (WHERE "TotalCharges" IS NULL) AS "TotalCharges"
        FROM ({CLEAN_SQL}) AS clean""",
)
def null_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_counts(clean_values(raw_customers(spark, sf_dir)), ["customerID", "MonthlyCharges", "TotalCharges"])


@query(
    "clean_blank_numeric",
    f"""SELECT "customerID", TRY_CAST(CASE WHEN trim("TotalCharges") = '' THEN NULL ELSE "TotalCharges" END AS DOUBLE)
              AS total_charges
       FROM ({RAW_SQL}) AS raw""",
)
def clean_blank_numeric_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_customers(spark, sf_dir)
    return raw.select("customerID", blank_to_double(F.col("TotalCharges")).alias("total_charges"))


@query(
    "clean_yes_no",
    f"""SELECT "customerID", CAST(CASE WHEN lower("Churn") = 'yes' THEN 1 ELSE 0 END AS INTEGER) AS churn
       FROM ({RAW_SQL}) AS raw""",
)
def clean_yes_no_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_customers(spark, sf_dir).select("customerID", yes_flag(F.col("Churn")).alias("churn"))


@query(
    "feat_equals",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS INTEGER) AS is_open
       FROM lineitem""",
)
def feat_equals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", flag_equals(F.col("l_linestatus"), "O").alias("is_open"))


@query(
    "feat_not_equals",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS INTEGER) AS returned
       FROM lineitem""",
)
def feat_not_equals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", flag_not_equals(F.col("l_returnflag"), "N").alias("returned"))


@query(
    "feat_guarded_ratio",
    """SELECT l_orderkey, l_linenumber,
              CASE WHEN l_quantity - 1 > 0 THEN l_extendedprice / (l_quantity - 1) ELSE l_tax END AS unit_rate
       FROM lineitem""",
)
def feat_guarded_ratio_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = guarded_ratio(F.col("l_extendedprice"), F.col("l_quantity") - 1, F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rate.alias("unit_rate"))


@query(
    "feat_threshold",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity > 24 THEN 1 ELSE 0 END AS INTEGER) AS is_bulk
       FROM lineitem""",
)
def feat_threshold_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", flag_above(F.col("l_quantity"), 24).alias("is_bulk"))


@query("fn_trim", "SELECT c_custkey, trim('  ' || c_name || ' ') AS trimmed FROM customer")
def fn_trim_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", F.trim(padded).alias("trimmed"))


@query("fn_lower", "SELECT c_custkey, lower(c_mktsegment) AS segment FROM customer")
def fn_lower_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("segment"))


@query(
    "fn_divide",
    "SELECT l_orderkey, l_linenumber, l_extendedprice / l_linenumber AS price_per_line FROM lineitem",
)
def fn_divide_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.col("l_extendedprice") / F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("price_per_line"))


@query(
    "fn_current_timestamp",
    """SELECT event_type, count(*) AS "rows", CAST(1 AS BIGINT) AS stamps, CAST(0 AS BIGINT) AS missing
       FROM events GROUP BY event_type""",
)
def fn_current_timestamp_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stamp differs between runs, so the query reports how many values a run has."""
    stamped = stamp(table(spark, sf_dir, "events"))
    per_stamp = stamped.groupBy("event_type", "ingested_at").agg(F.count(F.lit(1)).alias("rows"))
    return per_stamp.groupBy("event_type").agg(
        F.sum("rows").alias("rows"),
        F.count("ingested_at").alias("stamps"),
        F.count_if(F.col("ingested_at").isNull()).alias("missing"),
    )


@query(
    "fn_coalesce_zero",
    f"""SELECT customer_id, coalesce(senior_citizen, 0) AS senior_citizen, coalesce(tenure, 0) AS tenure,
               coalesce(total_charges, 0) AS total_charges,
               coalesce(charges_per_month_tenure, 0) AS charges_per_month_tenure
        FROM ({GOLD_SQL}) AS gold""",
)
def fn_coalesce_zero_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["senior_citizen", "tenure", "total_charges", "charges_per_month_tenure"]
    gold = silver_to_gold(bronze_to_silver(raw_customers(spark, sf_dir)))
    return fill_zero(gold.select("customer_id", *names), names)


@query("fn_format_id", "SELECT c_custkey, printf('CUST-%05d', c_custkey) AS customer_id FROM customer")
def fn_format_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return customers.select("c_custkey", format_customer_id(F.col("c_custkey")).alias("customer_id"))


@query("fn_round", "SELECT event_id, round(value / 7, 2) AS rounded FROM events")
def fn_round_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", round_cents(F.col("value") / 7).alias("rounded"))


@query(
    "fn_iso_timestamp",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso, epoch_us(ts) AS micros FROM events""",
)
def fn_iso_timestamp_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = table(spark, sf_dir, "events").select("event_id", iso_utc(F.col("ts")).alias("iso"))
    return written.withColumn("micros", F.unix_micros(parse_iso(F.col("iso"))))


@query(
    "label_encode",
    """SELECT o_orderkey, o_orderpriority,
              CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS priority_code
       FROM orders""",
)
def label_encode_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return label_encode(orders, "o_orderpriority", "priority_code")


@query(
    "label_encode_nulls",
    f"""SELECT "customerID", "InternetService",
              CAST(CASE WHEN "InternetService" IS NULL
                        THEN (SELECT count(DISTINCT "InternetService") FROM ({RAW_SQL}) AS all_rows)
                        ELSE dense_rank() OVER (ORDER BY "InternetService" NULLS LAST) - 1 END AS INTEGER) AS code
       FROM ({RAW_SQL}) AS raw""",
)
def label_encode_nulls_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_customers(spark, sf_dir).select("customerID", "InternetService")
    return label_encode(raw, "InternetService", "code")


@query(
    "label_encode_shuffled",
    """SELECT l_orderkey, l_linenumber, label,
              CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code
       FROM (SELECT l_orderkey, l_linenumber,
                    CASE WHEN l_returnflag = 'A' THEN 'A' ELSE CAST(l_partkey AS VARCHAR) END AS label
             FROM lineitem) AS labelled""",
)
def label_encode_shuffled_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path for a code table too large to broadcast, with one label on a third of all rows."""
    label = F.when(F.col("l_returnflag") == "A", F.lit("A")).otherwise(F.col("l_partkey").cast("string"))
    labelled = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"))
    return label_encode(labelled, "label", "code", broadcast_bytes=0, hot_share=0.01)


@query(
    "flag_null_predicate",
    f"""SELECT "customerID", CAST(CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END AS INTEGER) AS is_yes
       FROM ({RAW_SQL}) AS raw""",
)
def flag_null_predicate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_customers(spark, sf_dir).select("customerID", flag(F.col("Churn") == "Yes").alias("is_yes"))
