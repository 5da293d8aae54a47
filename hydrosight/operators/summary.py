"""The customer-level summary (D32) and its lot-size enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrosight.functions import round_half_even
from hydrosight.operators.dedup import keep_last
from hydrosight.operators.parse import number
from hydrosight.params import DEFAULT, Params
from hydrosight.sources.schemas import METRIC_COLUMNS, ORD, SUMMARY_COLUMNS

FOUR_PLACES = ["summer_billed_daily_avg_kgal", "summer_triple_billed_daily_avg_kgal"]
TWO_PLACES = ["summer_mean_normalized_30day_kgal", "summer_median_normalized_30day_kgal",
              *METRIC_COLUMNS, "winter_mean_normalized_30day_kgal",
              "winter_median_normalized_30day_kgal"]
SUMMARY_SORT = ["SP_ID", "PER_ID", "ACCT_ID"]


def build_summary(contacts: DataFrame, candidate_stats: DataFrame, metrics: DataFrame,
                  p: Params = DEFAULT) -> DataFrame:
    """Candidates with a person (inner), their attributes and season
    statistics, interval metrics (missing -> 0.0), rounded; the two bill
    counts stay unrounded. Sorting is left to the sink."""
    df = (contacts.join(candidate_stats, "SP_ID", "inner")
          .join(metrics.select("SP_ID", *METRIC_COLUMNS), "SP_ID", "left"))
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in METRIC_COLUMNS})
    rounded = {c: round_half_even(F.col(c), 4) for c in FOUR_PLACES}
    rounded.update({c: round_half_even(F.col(c), 2) for c in TWO_PLACES})
    return df.withColumns(rounded).select(*SUMMARY_COLUMNS)


def clean_parcel(raw: DataFrame) -> DataFrame:
    """Ids kept as read (not stripped), null ids dropped, the last row
    per id in file order wins."""
    df = raw.select("CIS_SP_ID", number(raw, "LND_SQFOOT").alias("LND_SQFOOT"),
                    *([ORD] if ORD in raw.columns else []))
    return keep_last(df.where(F.col("CIS_SP_ID").isNotNull()), ["CIS_SP_ID"])


def with_parcel(summary: DataFrame, raw_parcel: DataFrame | None) -> DataFrame:
    """Left join on SP_ID = CIS_SP_ID; the right key is dropped."""
    if raw_parcel is None:
        return summary
    parcel = clean_parcel(raw_parcel).withColumnRenamed("CIS_SP_ID", "SP_ID")
    return summary.join(parcel, "SP_ID", "left").select(*SUMMARY_COLUMNS, "LND_SQFOOT")
