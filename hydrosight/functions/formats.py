"""Text forms of timestamps, and which of them a column is written in.

Fixed values: the forms below, each with the pattern of its text and the ISO text made
of it. A form is named in ``Params.ts_formats`` by its key; a column's form can also be
found from the data (``infer_ts_forms``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TIME = r"[ T](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)$"
TS_FORMS = {
    "Y-M-D": (r"^(\d{4})-(\d{2})-(\d{2})" + _TIME, "$1-$2-$3 $4"),
    "Y/M/D": (r"^(\d{4})/(\d{2})/(\d{2})" + _TIME, "$1-$2-$3 $4"),
    "M/D/Y": (r"^(\d{2})/(\d{2})/(\d{4})" + _TIME, "$3-$1-$2 $4"),
    "D/M/Y": (r"^(\d{2})/(\d{2})/(\d{4})" + _TIME, "$3-$2-$1 $4"),
    "M-D-Y": (r"^(\d{2})-(\d{2})-(\d{4})" + _TIME, "$3-$1-$2 $4"),
    "D-M-Y": (r"^(\d{2})-(\d{2})-(\d{4})" + _TIME, "$3-$2-$1 $4"),
}
#: the value of ``Params.ts_format`` that asks for inference
INFER = "infer"


def form_ts(raw: Column, form: str) -> Column:
    """The timestamp of text in the form, null for any other text."""
    pattern, iso = TS_FORMS[form]
    return F.when(raw.rlike(pattern), F.regexp_replace(raw, pattern, iso).try_cast("timestamp_ntz"))


def infer_ts_forms(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The one form that every non-null text of a column has, from one pass over all rows.

    Each value is the bit mask of the forms that read it; the masks of a column are
    joined by AND, so a task and the driver hold one number a column. No form is an error, and
    so are several: where every day is at most 12, the data do not say which number is the
    month. A column without text is ISO.
    """
    texts = [c for c in columns if dict(df.dtypes)[c] == "string"]
    if not texts:
        return {}

    def mask(c):
        raw = F.col(c)
        return sum((F.when(form_ts(raw, form).isNotNull(), 1 << i).otherwise(0)
                    for i, form in enumerate(TS_FORMS)), F.lit(0))
    found = df.agg(*(F.bit_and(F.when(F.col(c).isNotNull(), mask(c))).alias(c) for c in texts)).first()
    forms = {}
    for c in texts:
        fits = [f for i, f in enumerate(TS_FORMS) if found[c] is None or found[c] >> i & 1]
        if not fits:
            raise ValueError(f"no timestamp form fits all of {c}; name a pattern for it")
        if found[c] is not None and len(fits) > 1:
            raise ValueError(f"{c} may be any of {', '.join(fits)}; name one")
        forms[c] = fits[0]
    return forms
