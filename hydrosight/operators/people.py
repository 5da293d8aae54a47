"""Contacts: phone-type canonical form (D5), cleaning (D6) and the
service-point contact list (D31)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrosight.functions import strip_ws
from hydrosight.operators.dedup import keep_first
from hydrosight.params import DEFAULT, Params
from hydrosight.sources.schemas import ORD, PERSON_COLUMNS

CONTACT_COLUMNS = ["SP_ID", "ACCT_ID", "PER_ID", "ENTITY_NAME", "EMAILID", "PHONE_TYPE_CD", "PHONE"]


def phone_type(c, p: Params = DEFAULT) -> Column:
    """Fold the known codes; anything else stays as cleaned input."""
    cleaned = F.upper(strip_ws(c))
    out = None
    for canonical, codes in p.phone_types:
        cond = cleaned.isin(*codes)
        out = F.when(cond, F.lit(canonical)) if out is None else out.when(cond, F.lit(canonical))
    return out.otherwise(cleaned)


def clean_people(raw: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Strip, lower e-mail, canonical phone type, drop null keys, keep
    the first row per (ACCT_ID, PER_ID) in file order."""
    cols = PERSON_COLUMNS + ([ORD] if ORD in raw.columns else [])
    # null keys are null before stripping too: test the text (cheap pushdown)
    df = raw.select(*cols).where(F.col("ACCT_ID").isNotNull() & F.col("PER_ID").isNotNull())
    df = df.withColumns({
        "ACCT_ID": strip_ws("ACCT_ID"),
        "PER_ID": strip_ws("PER_ID"),
        "ENTITY_NAME": strip_ws("ENTITY_NAME"),
        "EMAILID": F.lower(strip_ws("EMAILID")),
        "PHONE_TYPE_CD": phone_type("PHONE_TYPE_CD", p),
        "PHONE": strip_ws("PHONE"),
    })
    return keep_first(df, ["ACCT_ID", "PER_ID"])


def sp_contacts(usage: DataFrame, people: DataFrame) -> DataFrame:
    """Distinct (SP_ID, ACCT_ID) from bills joined to every person of
    the account (many to many). Pairs and cleaned people have no repeats, so the
    result has none; with no aggregate above it, AQE can split a hot account."""
    pairs = usage.select("SP_ID", "ACCT_ID").distinct()
    return pairs.join(people.drop(ORD), "ACCT_ID", "inner").select(*CONTACT_COLUMNS)
