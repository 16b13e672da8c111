"""Column expressions for identifiers, timestamps and money as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_customer_id(n: Column) -> Column:
    """``CUST-`` and the number, zero-padded to at least five digits."""
    return F.format_string("CUST-%05d", n)


def iso_utc(ts: Column) -> Column:
    """ISO-8601 UTC text with microseconds, independent of the session time zone.

    ``ts`` is a wall-clock time in UTC (``timestamp_ntz``).
    """
    text = ts.cast("timestamp_ntz").cast("string")
    fraction = F.rpad(F.substring(text, 21, 6), 6, "0")
    return F.concat(
        F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."), fraction, F.lit("+00:00")
    )


def utc_now() -> Column:
    """The query's start time as a wall-clock time in UTC."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


def parse_iso(text: Column) -> Column:
    """Timestamp from ISO-8601 text; null when it does not parse."""
    return F.try_to_timestamp(text)


def round_cents(c: Column) -> Column:
    return F.round(c, 2)
