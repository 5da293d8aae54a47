"""Scalar column expressions. All are built-in Spark functions, so they stay
inside whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrosight.functions.formats import TS_FORMS, form_ts

# The Unicode White_Space characters (U+0009..U+000D, U+0020,
# U+0085, U+00A0, U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F,
# U+3000). Stripping removes any of them from both ends of a string.
WHITESPACE = "".join(
    chr(c)
    for c in [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Strip all Unicode whitespace from both ends (``trim`` only strips
    U+0020). An all-blank string becomes '' and stays non-null."""
    return F.btrim(_c(c).cast("string"), F.lit(WHITESPACE))


def whole_seconds(end, begin) -> Column:
    """Whole seconds of ``end - begin`` for naive timestamps, truncated toward
    zero (86400.9 s -> 86400, -0.9 s -> 0). No time zone is involved."""
    return (_c(end) - _c(begin)).cast("interval second").cast("bigint")


def days_between(end, begin, seconds_per_day: float) -> Column:
    return whole_seconds(end, begin) / F.lit(seconds_per_day)


def _fail(raw: Column, what: str, dtype: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"unparseable {what}: "), raw.cast("string"))).cast(dtype)


#: the text forms that are read without a pattern: date, 'T' or a blank, hours and
#: minutes, with or without seconds and a fraction; no zone, no offset, no blanks around
ISO_TEXT = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"
#: decimal numbers, NaN and infinities; no type suffix, no blanks around
NUMBER_TEXT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$|^[+-]?([nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def try_ts(c, fmt: str | None = None) -> Column:
    """Text -> TIMESTAMP_NTZ, null where it is no such text. ``fmt=None`` reads ``ISO_TEXT``
    through Spark's cast, a key of ``TS_FORMS`` that form; any other pattern goes to
    ``to_timestamp_ntz`` (which raises by itself under ANSI)."""
    raw = _c(c)
    if fmt in TS_FORMS:
        return form_ts(raw, fmt)
    if fmt is None:
        return F.when(raw.rlike(ISO_TEXT), raw.try_cast("timestamp_ntz"))
    return F.to_timestamp_ntz(raw, F.lit(fmt))


def parse_ts(c, fmt: str | None = None, what: str = "timestamp") -> Column:
    """``try_ts``, strict: unparseable non-null text fails the job, under ANSI and without it."""
    raw = _c(c)
    return F.coalesce(try_ts(raw, fmt), F.when(raw.isNotNull(), _fail(raw, what, "timestamp_ntz")))


def try_double(c) -> Column:
    """Text -> double, null where it is no number."""
    raw = _c(c).cast("string")
    return F.when(raw.rlike(NUMBER_TEXT), raw.try_cast("double"))


def parse_double(c, what: str = "number") -> Column:
    """``try_double``, strict like ``parse_ts``."""
    raw = _c(c)
    return F.coalesce(try_double(raw), F.when(raw.isNotNull(), _fail(raw, what, "double")))


def round_half_even(c, digits: int) -> Column:
    """Round to ``digits`` decimals, ties to even, on the scaled double."""
    scale = float(10 ** digits)
    return F.rint(_c(c) * F.lit(scale)) / F.lit(scale)


def report(c, digits: int = 6) -> Column:
    """Fixed decimals for reported intermediate doubles."""
    return round_half_even(c, digits)
