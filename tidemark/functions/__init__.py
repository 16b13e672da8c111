"""Column expressions; all of them are built-in functions and stay in generated code."""

from tidemark.functions.cleaning import blank_to_double, flag, to_double, to_int, yes_flag
from tidemark.functions.features import flag_above, flag_equals, flag_not_equals, guarded_ratio
from tidemark.functions.text import format_customer_id, iso_utc, parse_iso, round_cents, utc_now

__all__ = [
    "blank_to_double",
    "flag",
    "flag_above",
    "flag_equals",
    "flag_not_equals",
    "format_customer_id",
    "guarded_ratio",
    "iso_utc",
    "parse_iso",
    "round_cents",
    "to_double",
    "to_int",
    "utc_now",
    "yes_flag",
]
