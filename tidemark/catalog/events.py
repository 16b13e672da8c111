"""Customer events: generation, encoding, parsing and their contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog import query
from tidemark.catalog.inputs import ORDER_EVENTS_SQL, table
from tidemark.config import EVENT_SCHEMA
from tidemark.functions import format_customer_id, iso_utc
from tidemark.operators.events import (
    dq_event_contract,
    dq_message_contract,
    encode_events,
    flag_violations,
    generate_events,
    key_set_matches,
    parse_events,
)


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic event per order, at the order's date."""
    return generate_events(table(spark, sf_dir, "orders"), "o_orderkey", seed=42, at=F.col("o_orderdate"))


# Events with natural contract breaks: amounts, counts and types from the events table.
MIXED_EVENTS_SQL = """
SELECT CASE WHEN event_type = 'error' THEN 'user ' || user_id ELSE printf('CUST-%05d', user_id) END AS customer_id,
       CASE WHEN event_type = 'signup' THEN CASE user_id % 5
                 WHEN 0 THEN 'yesterday' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                 WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+05:30'
                 WHEN 3 THEN '2024-02-30T00:00:00+00:00' ELSE strftime(ts, '%Y-%m-%d') END
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS "timestamp",
       CASE WHEN event_type = 'view' THEN 'DSL' WHEN event_type = 'click' THEN 'dsl' END AS internet_service,
       CASE WHEN event_type = 'purchase' THEN 'One year' ELSE event_type END AS contract,
       'Mailed check' AS payment_method,
       value / 2 AS monthly_charges,
       CAST(user_id AS INTEGER) AS tenure_months,
       CAST(floor(value / 10) AS INTEGER) AS support_calls,
       CAST(floor(value / 20) AS INTEGER) AS late_payments
FROM events
"""


def odd_times(user: Column, ts: Column) -> Column:
    """No time, a time without offset, with another one, a day that does not exist, a date alone."""
    clock = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return (
        F.when(user % 5 == 0, "yesterday")
        .when(user % 5 == 1, clock)
        .when(user % 5 == 2, F.concat(clock, F.lit("+05:30")))
        .when(user % 5 == 3, "2024-02-30T00:00:00+00:00")
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def mixed_events(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind, user, value = F.col("event_type"), F.col("user_id"), F.col("value")
    return events.select(
        *keep,
        F.when(kind == "error", F.concat(F.lit("user "), user.cast("string")))
        .otherwise(format_customer_id(user))
        .alias("customer_id"),
        F.when(kind == "signup", odd_times(user, F.col("ts"))).otherwise(iso_utc(F.col("ts"))).alias("timestamp"),
        F.when(kind == "view", "DSL").when(kind == "click", "dsl").alias("internet_service"),
        F.when(kind == "purchase", "One year").otherwise(kind).alias("contract"),
        F.lit("Mailed check").alias("payment_method"),
        (value / 2).alias("monthly_charges"),
        user.cast("int").alias("tenure_months"),
        F.floor(value / 10).cast("int").alias("support_calls"),
        F.floor(value / 20).cast("int").alias("late_payments"),
    )


_RULES_SQL = {
    "customer_id_format": "regexp_full_match(customer_id, 'CUST-([0-9]{5}|[1-9][0-9]{5,})')",
    "timestamp_iso": "try_cast(\"timestamp\" AS TIMESTAMPTZ) IS NOT NULL",
    "internet_service_domain": "internet_service IN ('DSL', 'Fiber optic', 'No')",
    "contract_domain": "contract IN ('Month-to-month', 'One year', 'Two year')",
    "payment_method_domain": (
        "payment_method IN ('Electronic check', 'Mailed check', 'Bank transfer', 'Credit card')"
    ),
    "monthly_charges_range": "monthly_charges BETWEEN 20 AND 120",
    "monthly_charges_cents": "round(monthly_charges, 2) = monthly_charges",
    "tenure_months_range": "tenure_months BETWEEN 1 AND 72",
    "support_calls_range": "support_calls BETWEEN 0 AND 10",
    "late_payments_range": "late_payments BETWEEN 0 AND 5",
}


@query("generate_events", ORDER_EVENTS_SQL)
def generate_events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_events(spark, sf_dir)


@query(
    "encode_events",
    f"""SELECT json_object('customer_id', customer_id, 'timestamp', "timestamp", 'internet_service', internet_service,
               'contract', contract, 'payment_method', payment_method, 'monthly_charges', monthly_charges,
               'tenure_months', tenure_months, 'support_calls', support_calls, 'late_payments', late_payments
               )::VARCHAR AS value
        FROM ({ORDER_EVENTS_SQL}) AS e""",
)
def encode_events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_events(order_events(spark, sf_dir))


@query("parse_events", ORDER_EVENTS_SQL)
def parse_events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as messages and read back: nothing is lost on the way."""
    return parse_events(encode_events(order_events(spark, sf_dir)))


@query("fn_from_json", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def fn_from_json_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id"), F.col("props").alias("value"))
    # The operator returns the parsed fields alone, so the key travels inside the message.
    rest = F.substring("value", 2, 1 << 30)
    keyed = events.select(F.concat(F.lit('{"event_id":'), "event_id", F.lit(","), rest).alias("value"))
    return parse_events(keyed, T._parse_datatype_string("event_id bigint, k int"))


@query(
    "event_key_set",
    """SELECT event_type, count(*) AS "rows",
              count(*) FILTER (WHERE event_type <> 'error') AS exact
       FROM events GROUP BY event_type""",
)
def event_key_set_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of one event type lack a key, the others have exactly the declared ones."""
    return short_messages(spark, sf_dir).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(key_set_matches()).alias("exact")
    )


def short_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event type and message body; messages of one type lack the first key."""
    events = mixed_events(spark, sf_dir, "event_type")
    short = F.to_json(F.struct(*EVENT_SCHEMA.names[1:]), {"ignoreNullFields": "false"})
    whole = F.to_json(F.struct(*EVENT_SCHEMA.names), {"ignoreNullFields": "false"})
    return events.select("event_type", F.when(F.col("event_type") == "error", short).otherwise(whole).alias("value"))


@query(
    "dq_message_contract",
    """SELECT 'key_set' AS rule, count(*) FILTER (WHERE event_type = 'error') AS violations, count(*) AS "rows"
       FROM events UNION ALL """
    + " UNION ALL ".join(
        # A body without an id has a null id; in this input its other spelling breaks the same rule.
        f"""SELECT '{rule}' AS rule, count(*) FILTER (WHERE NOT coalesce({test}, false)) AS violations,
                   count(*) AS "rows" FROM ({MIXED_EVENTS_SQL}) AS e"""
        for rule, test in _RULES_SQL.items()
    ),
)
def dq_message_contract_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dq_message_contract(short_messages(spark, sf_dir))


@query(
    "dq_event_contract",
    " UNION ALL ".join(
        f"""SELECT '{rule}' AS rule, count(*) FILTER (WHERE NOT coalesce({test}, false)) AS violations,
                   count(*) AS "rows" FROM ({MIXED_EVENTS_SQL}) AS e"""
        for rule, test in _RULES_SQL.items()
    ),
)
def dq_event_contract_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dq_event_contract(parse_events(encode_events(mixed_events(spark, sf_dir))))


@query(
    "event_quarantine",
    f"""SELECT * FROM (
          SELECT customer_id, "timestamp", monthly_charges, concat_ws(',', """
    + ", ".join(f"CASE WHEN NOT coalesce({test}, false) THEN '{rule}' END" for rule, test in _RULES_SQL.items())
    + f""") AS violations FROM ({MIXED_EVENTS_SQL}) AS e) AS flagged
        WHERE violations <> ''""",
)
def event_quarantine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = flag_violations(parse_events(encode_events(mixed_events(spark, sf_dir))))
    return flagged.where(F.size("violations") > 0).select(
        "customer_id", "timestamp", "monthly_charges", F.array_join("violations", ",").alias("violations")
    )
