import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.config import CONTRACTS, EVENT_SCHEMA, PAYMENT_METHODS, SERVICES
from tidemark.operators.events import (
    dq_event_contract,
    dq_message_contract,
    encode_events,
    flag_violations,
    generate_events,
    key_set_matches,
    parse_events,
    quarantine,
)


@pytest.fixture(scope="module")
def events(spark):
    return generate_events(spark.range(2000), "id").collect()


def test_keys(events):
    assert set(events[0].asDict()) == set(EVENT_SCHEMA.names)
    assert len(EVENT_SCHEMA.names) == 9


def test_types(spark):
    assert generate_events(spark.range(1), "id").schema.simpleString() == EVENT_SCHEMA.simpleString()


@pytest.mark.parametrize(
    "n, text", [(42, "CUST-00042"), (0, "CUST-00000"), (99999, "CUST-99999"), (123456, "CUST-123456")]
)
def test_id_format(spark, n, text):
    assert generate_events(spark.range(n, n + 1), "id").first().customer_id == text


def test_categories(events):
    assert {e.internet_service for e in events} == set(SERVICES)
    assert {e.contract for e in events} == set(CONTRACTS)
    assert {e.payment_method for e in events} == set(PAYMENT_METHODS)


def test_ranges(events):
    assert all(20 <= e.monthly_charges <= 120 for e in events)
    assert {e.tenure_months for e in events} == set(range(1, 73))
    assert {e.support_calls for e in events} == set(range(11))
    assert {e.late_payments for e in events} == set(range(6))


def test_draws_are_spread_evenly(events):
    mean = sum(e.monthly_charges for e in events) / len(events)
    assert 67 < mean < 73
    for value in SERVICES:
        assert 0.28 < sum(e.internet_service == value for e in events) / len(events) < 0.39


def test_timestamp_is_iso_utc(events):
    for e in events[:50]:
        assert datetime.fromisoformat(e.timestamp).utcoffset().total_seconds() == 0


def test_timestamp_is_now_whatever_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        text = generate_events(spark.range(1), "id").first().timestamp
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    age = datetime.now(datetime.fromisoformat(text).tzinfo) - datetime.fromisoformat(text)
    assert abs(age.total_seconds()) < 120


def test_cents(events):
    assert all(round(e.monthly_charges, 2) == e.monthly_charges for e in events)


def test_same_seed_same_events_on_any_partitioning(spark):
    def made(parts, seed):
        rows = generate_events(spark.range(0, 300, 1, parts), "id", seed).drop("timestamp").collect()
        return sorted(map(tuple, rows))

    assert made(1, 7) == made(5, 7)
    assert made(1, 7) != made(1, 8)


def test_messages_are_json_and_round_trip(spark):
    made = generate_events(spark.range(200), "id", at=F.lit("2024-05-01 10:00:00").cast("timestamp_ntz"))
    messages = encode_events(made)
    assert json.loads(messages.first().value)["timestamp"] == "2024-05-01T10:00:00.000000+00:00"
    assert messages.where(~key_set_matches()).count() == 0
    assert sorted(map(tuple, parse_events(messages).collect())) == sorted(map(tuple, made.collect()))


def test_null_fields_are_written(spark):
    df = spark.createDataFrame([(None, 1)], "a string, b int")
    assert encode_events(df).first().value == '{"a":null,"b":1}'


CASES = [
    ('{"customer_id":"C","monthly_charges":1.5,"tenure_months":3,"other":1}', ("C", 1.5, 3), False),
    ("not json", (None, None, None), True),
    ("[]", (None, None, None), True),
    ('{"customer_id":"C"', (None, None, None), True),
    ("", (None, None, None), True),
    (" ", (None, None, None), True),
    ('{"customer_id":"C","monthly_charges":"12.5","tenure_months":3}', ("C", None, 3), True),
    ('{"customer_id":"C","monthly_charges":1.5,"tenure_months":3.0}', ("C", 1.5, None), True),
    ('{"customer_id":42}', ("42", None, None), False),
    ("{}", (None, None, None), False),
]


@pytest.mark.parametrize("message, expected, corrupt", CASES)
@pytest.mark.parametrize("kind", ["string", "binary"])
def test_parse(spark, message, expected, corrupt, kind):
    df = spark.createDataFrame([(message,)], "value string").select(F.col("value").cast(kind))
    row = parse_events(df).first()
    assert (row.customer_id, row.monthly_charges, row.tenure_months) == expected
    kept = parse_events(df, keep_corrupt=True).first()
    assert (kept.customer_id, kept.monthly_charges, kept.tenure_months) == expected
    assert kept["_corrupt_record"] == (message if corrupt else None)


def test_missing_body(spark):
    df = spark.createDataFrame([(None,)], "value string")
    assert parse_events(df).first().customer_id is None
    assert parse_events(df, keep_corrupt=True).first()["_corrupt_record"] == ""


GOOD = ("CUST-00001", "2024-01-01T00:00:00+00:00", "DSL", "One year", "Mailed check", 50.25, 5, 0, 0)


@pytest.mark.parametrize(
    "field, value, rule",
    [
        ("customer_id", "CUST-1", "customer_id_format"),
        ("customer_id", "CUST-000001", "customer_id_format"),
        ("customer_id", None, "customer_id_format"),
        ("timestamp", "yesterday", "timestamp_iso"),
        ("timestamp", "2024-13-01T00:00:00+00:00", "timestamp_iso"),
        ("timestamp", "2024-02-30", "timestamp_iso"),
        ("timestamp", "01.02.2024", "timestamp_iso"),
        ("internet_service", "dsl", "internet_service_domain"),
        ("contract", "Weekly", "contract_domain"),
        ("payment_method", None, "payment_method_domain"),
        ("monthly_charges", 19.99, "monthly_charges_range"),
        ("monthly_charges", 120.01, "monthly_charges_range"),
        ("monthly_charges", 50.255, "monthly_charges_cents"),
        ("tenure_months", 0, "tenure_months_range"),
        ("tenure_months", 73, "tenure_months_range"),
        ("support_calls", 11, "support_calls_range"),
        ("late_payments", 6, "late_payments_range"),
        ("late_payments", -1, "late_payments_range"),
    ],
)
def test_contract_rule(spark, field, value, rule):
    bad = tuple(value if name == field else v for name, v in zip(EVENT_SCHEMA.names, GOOD))
    df = spark.createDataFrame([GOOD, bad], EVENT_SCHEMA)
    broken = {r.rule: r.violations for r in dq_event_contract(df).collect() if r.violations}
    assert broken == {rule: 1}
    rows = quarantine(df).collect()
    assert [r.violations for r in rows] == [[rule]]
    assert rows[0][field] == value


def test_generated_events_keep_the_contract(spark):
    report = dq_event_contract(generate_events(spark.range(500), "id")).collect()
    assert len(report) == 10
    assert all(r.violations == 0 and r.rows == 500 for r in report)


def test_message_contract(spark):
    good = json.dumps(dict(zip(EVENT_SCHEMA.names, GOOD)))
    more = json.dumps(dict(zip(EVENT_SCHEMA.names, GOOD)) | {"more": 1})
    df = spark.createDataFrame([(good,), (more,), ("not json",)], "value string")
    report = {r.rule: (r.violations, r["rows"]) for r in dq_message_contract(df).collect()}
    assert report.pop("key_set") == (2, 3)
    assert set(report.values()) == {(1, 3)} and len(report) == 10


@pytest.mark.parametrize(
    "message, exact",
    [
        (json.dumps(dict.fromkeys(reversed(EVENT_SCHEMA.names))), True),
        (json.dumps(dict.fromkeys(EVENT_SCHEMA.names[1:])), False),
        (json.dumps(dict.fromkeys([*EVENT_SCHEMA.names, "more"])), False),
        ("not json", False),
    ],
)
def test_key_set(spark, message, exact):
    df = spark.createDataFrame([(message,)], "value string")
    assert df.select(key_set_matches()).first()[0] is exact


def test_violations_of_an_empty_event(spark):
    df = spark.createDataFrame([(None,) * 9], EVENT_SCHEMA)
    assert len(flag_violations(df).first().violations) == 10


@pytest.mark.parametrize(
    "text",
    ["2024-01-01", "2024-01-01T00:00:00", "2024-01-01T10:00:00.5Z", "2024-01-01T10:00:00+05:30", "2024-01-01T10:00"],
)
def test_times_of_the_contract(spark, text):
    datetime.fromisoformat(text)
    broken = flag_violations(generate_events(spark.range(1), "id").withColumn("timestamp", F.lit(text))).first()
    assert broken.violations == []
