"""Customer events: make, encode, parse and check them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import (
    CONTRACTS,
    EVENT_ID_PATTERN,
    EVENT_RANGES,
    EVENT_SCHEMA,
    ISO_PATTERN,
    PAYMENT_METHODS,
    SERVICES,
)
from tidemark.functions import format_customer_id, iso_utc, parse_iso, round_cents, utc_now

CORRUPT = "_corrupt_record"


def _draws(n: Column, seed: int, bounds: list[int]) -> list[Column]:
    """One whole number in ``[0, bound)`` per bound, all cut from a single hash.

    A hash of the id gives the same event in every run, whatever the partitioning, where
    ``rand`` would depend on the partition a row lands in.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), n.cast("string")).cast("binary"), 256)
    return [
        F.shiftright(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") * F.lit(bound), 32)
        for i, bound in enumerate(bounds)
    ]


def generate_events(ids: DataFrame, id_column: str, seed: int = 42, at: Column | None = None) -> DataFrame:
    """One synthetic event per row of ``ids``, uniform over the field domains.

    ``at`` is the event time as a UTC wall-clock time; the default is the start of the query.
    ``generate_events(spark.range(n), "id")`` makes n events on all executors.
    """
    n = F.col(id_column)
    spans = [high - low + 1 for low, high in EVENT_RANGES.values()]
    low = {name: bounds[0] for name, bounds in EVENT_RANGES.items()}
    cents = (EVENT_RANGES["monthly_charges"][1] - low["monthly_charges"]) * 100 + 1
    service, contract, payment, charge, tenure, calls, late = _draws(
        n, seed, [len(SERVICES), len(CONTRACTS), len(PAYMENT_METHODS), cents, *spans[1:]]
    )

    def pick(values: tuple[str, ...], draw: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (draw + 1).cast("int"))

    return ids.select(
        format_customer_id(n).alias("customer_id"),
        iso_utc(utc_now() if at is None else at).alias("timestamp"),
        pick(SERVICES, service).alias("internet_service"),
        pick(CONTRACTS, contract).alias("contract"),
        pick(PAYMENT_METHODS, payment).alias("payment_method"),
        ((charge + low["monthly_charges"] * 100) / F.lit(100.0)).alias("monthly_charges"),
        (tenure + low["tenure_months"]).cast("int").alias("tenure_months"),
        (calls + low["support_calls"]).cast("int").alias("support_calls"),
        (late + low["late_payments"]).cast("int").alias("late_payments"),
    )


def encode_events(df: DataFrame, out: str = "value") -> DataFrame:
    """Each row as one JSON object; null fields are written as nulls."""
    body = F.struct(*[F.col(name) for name in df.columns])
    return df.select(F.to_json(body, {"ignoreNullFields": "false"}).alias(out))


def parse_events(
    messages: DataFrame, schema: T.StructType = EVENT_SCHEMA, keep_corrupt: bool = False, value: str = "value"
) -> DataFrame:
    """Message bodies (text or bytes) as columns.

    Text that is no JSON object gives a row of nulls, a field of the wrong type a null, and
    unknown fields are dropped. ``keep_corrupt`` adds the text of such a message in
    ``_corrupt_record``, null for a message that parsed whole. An empty body has the empty
    text.
    """
    text = F.col(value).cast("string")
    if not keep_corrupt:
        return messages.select(F.from_json(text, schema, {"mode": "PERMISSIVE"}).alias("data")).select("data.*")
    target = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = messages.select(text.alias("_text"), F.from_json(text, target, options).alias("data"))
    # A blank or missing body yields no struct at all, so there is no field to hold its text.
    corrupt = F.when(F.col("data").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.col(f"data.{CORRUPT}"))
    return parsed.select(*[F.col(f"data.{name}") for name in schema.names], corrupt.alias(CORRUPT))


def event_rules() -> dict[str, Column]:
    """The event contract: rule name to a predicate every event must satisfy."""

    def within(name: str) -> Column:
        low, high = EVENT_RANGES[name]
        return F.col(name).between(low, high)

    return {
        "customer_id_format": F.col("customer_id").rlike(EVENT_ID_PATTERN),
        "timestamp_iso": F.col("timestamp").rlike(ISO_PATTERN) & parse_iso(F.col("timestamp")).isNotNull(),
        "internet_service_domain": F.col("internet_service").isin(*SERVICES),
        "contract_domain": F.col("contract").isin(*CONTRACTS),
        "payment_method_domain": F.col("payment_method").isin(*PAYMENT_METHODS),
        "monthly_charges_range": within("monthly_charges"),
        "monthly_charges_cents": round_cents(F.col("monthly_charges")) == F.col("monthly_charges"),
        "tenure_months_range": within("tenure_months"),
        "support_calls_range": within("support_calls"),
        "late_payments_range": within("late_payments"),
    }


def key_set_matches(value: str = "value") -> Column:
    """True where a message has exactly the declared keys, in any order."""
    keys = F.json_object_keys(F.col(value).cast("string"))
    declared = F.array(*[F.lit(name) for name in sorted(EVENT_SCHEMA.names)])
    return F.coalesce(F.sort_array(keys) == declared, F.lit(False))


def _holds(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def flag_violations(events: DataFrame, out: str = "violations") -> DataFrame:
    """Add the names of the rules a row breaks; a missing value breaks its rules."""
    broken = [F.when(~_holds(rule), F.lit(name)) for name, rule in event_rules().items()]
    return events.withColumn(out, F.array_compact(F.array(*broken)))


def quarantine(events: DataFrame) -> DataFrame:
    """The rows that break at least one rule, with the rules they break."""
    return flag_violations(events).where(F.size("violations") > 0)


def dq_event_contract(events: DataFrame) -> DataFrame:
    """Violations per rule: ``(rule, violations, rows)``, from one aggregate."""
    return _violations(events, event_rules())


def dq_message_contract(messages: DataFrame, value: str = "value") -> DataFrame:
    """The same for message bodies, with the rule that a body has exactly the declared keys."""
    parsed = F.from_json(F.col(value).cast("string"), EVENT_SCHEMA, {"mode": "PERMISSIVE"})
    checked = messages.select(key_set_matches(value).alias("_exact"), parsed.alias("data")).select("_exact", "data.*")
    return _violations(checked, {"key_set": F.col("_exact"), **event_rules()})


def _violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    counted = rows.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(~_holds(rule)).alias(name) for name, rule in rules.items()]
    )
    lines = [
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations"), F.col("rows").alias("rows"))
        for name in rules
    ]
    return counted.select(F.inline(F.array(*lines)))
