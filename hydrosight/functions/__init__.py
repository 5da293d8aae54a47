"""Column -> Column helpers shared by every operator."""

from hydrosight.functions.columns import (
    WHITESPACE,
    days_between,
    parse_double,
    parse_ts,
    report,
    round_half_even,
    strip_ws,
    try_double,
    try_ts,
    whole_seconds,
)

__all__ = [
    "WHITESPACE",
    "days_between",
    "parse_double",
    "parse_ts",
    "report",
    "round_half_even",
    "strip_ws",
    "try_double",
    "try_ts",
    "whole_seconds",
]
