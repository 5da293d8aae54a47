"""Strict typing of raw columns: text is parsed, typed columns pass through.

Each field is parsed once. The parsed fields leave one generator as columns, and the
check and the null test read those: a generator's output is not merged with the
expressions above it, nor are filters on it pushed below, so no pattern or cast is
repeated in a later filter, join condition or aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrosight.functions import parse_double, try_double, try_ts
from hydrosight.functions.formats import INFER, infer_ts_forms
from hydrosight.params import Params


def number(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] != "string":
        return F.col(name).cast("double")
    return parse_double(F.col(name), name)


def typed(df: DataFrame, timestamps: list[str], numbers: list[str], p: Params,
          required: list[str] | None = None) -> DataFrame:
    """``df`` with the named columns as TIMESTAMP_NTZ and double, without the rows where one of
    ``required`` is null (F1; tested on the raw text: stripping and parsing keep null as null). Rows
    that go for a null are checked too: unparseable text fails the job whatever the row's keys.
    One condition holds the check and the test, so that neither is decided without the other."""
    types = dict(df.dtypes)
    unknown = [c for c in timestamps if p.format_of(c) == INFER]
    if unknown:
        p = p.with_forms(infer_ts_forms(df, unknown))
    parsed = {c: try_ts(F.col(c), p.format_of(c)) for c in timestamps if types[c] != "timestamp_ntz"}
    parsed |= {c: try_double(F.col(c)) for c in numbers if types[c] == "string"}
    plain = {c: F.col(c).cast("double") for c in numbers if types[c] != "string"}
    keep = F.lit(True)
    for c in required or []:
        keep = keep & F.col(c).isNotNull()
    out = df
    if parsed:
        out = out.select("*", F.inline(F.array(F.struct(*(v.alias(f"_typed_{c}") for c, v in parsed.items())))))
        bad = F.lit(False)
        for c in parsed:
            bad = bad | (F.col(c).isNotNull() & F.col(f"_typed_{c}").isNull())
        shown = F.concat_ws(", ", *(F.col(c) for c in parsed))
        fail = F.raise_error(F.concat(F.lit(f"unparseable text in {', '.join(parsed)}: "), shown)).cast("boolean")
        keep = F.when(bad, fail).otherwise(keep)
    if parsed or required:
        out = out.where(keep)
    return out.select(*(F.col(f"_typed_{c}").alias(c) if c in parsed else plain[c].alias(c) if c in plain
                        else F.col(c) for c in df.columns))
