"""Bills: cleaning (D1-D4) and the per-service-point season statistics
(D9-D15). The season statistics and counts are one hash aggregate; medians and
premise lists, which need a service point's values together, are separate and
the job takes them for candidates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrosight.functions import days_between, strip_ws
from hydrosight.operators.dedup import keep_last
from hydrosight.operators.median import exact_median
from hydrosight.operators.parse import typed
from hydrosight.params import DEFAULT, Params
from hydrosight.sources.schemas import BILL_COLUMNS, ORD

REQUIRED = ["BSEG_ID", "SP_ID", "SA_ID", "ACCT_ID", "SA_TYPE_CD", "FINAL_REG_QTY",
            "START_READ_DTTM", "END_READ_DTTM"]


TIMESTAMPS, NUMBERS = ["START_READ_DTTM", "END_READ_DTTM"], ["FINAL_REG_QTY"]


def typed_bills(raw: DataFrame, p: Params = DEFAULT, required: list[str] | None = None) -> DataFrame:
    """Project, strip, upper-case and cast strictly; rows with a null in ``required`` go."""
    cols = BILL_COLUMNS + ([ORD] if ORD in raw.columns else [])
    df = typed(raw.select(*cols), TIMESTAMPS, NUMBERS, p, required)
    return df.withColumns({
        "BSEG_ID": strip_ws("BSEG_ID"),
        "SP_ID": strip_ws("SP_ID"),
        "SA_ID": strip_ws("SA_ID"),
        "ACCT_ID": strip_ws("ACCT_ID"),
        "SA_TYPE_CD": F.upper(strip_ws("SA_TYPE_CD")),
        "CHAR_PREM_ID": strip_ws("CHAR_PREM_ID"),
        "PREM_ID": strip_ws("PREM_ID"),
        "ADDRESS1": strip_ws("ADDRESS1"),
        "FINAL_UOM_CD": F.upper(strip_ws("FINAL_UOM_CD")),
    })


def dedup_bills(raw: DataFrame, p: Params = DEFAULT, columns: list[str] | None = None,
                where: Column | None = None) -> DataFrame:
    """Typed bills without null keys (F1: a NaN quantity stays), last copy per
    BSEG_ID in file order. ``columns`` narrows what the de-duplication carries;
    the null test and the parse check still cover every required column. ``where``
    filters the last copies."""
    rows = typed_bills(raw, p, REQUIRED)
    if columns is not None:
        rows = rows.select(*columns, *([ORD] if ORD in rows.columns else []))
    return keep_last(rows, ["BSEG_ID"], where=where)


def _bill_days(p: Params) -> Column:
    return days_between("END_READ_DTTM", "START_READ_DTTM", p.seconds_per_day)


def with_bill_days(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Whole seconds of the bill period over 86400."""
    return df.withColumn("bill_days", _bill_days(p))


def with_volume_and_season(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """D3 (30-day normalised kgal, operand order kept) and D4 (season)."""
    return df.withColumns({
        "normalized_30day_kgal": F.col("FINAL_REG_QTY") * F.lit(p.ccf_to_kgal)
        * F.lit(p.normalised_days) / F.col("bill_days"),
        "season": F.when(F.month("END_READ_DTTM").isin(*p.summer_months), F.lit("summer"))
        .otherwise(F.lit("winter")),
    })


# what the job reads from cleaned bills; the rest is dropped before the shuffle
JOB_BILL_COLUMNS = ["BSEG_ID", "SP_ID", "ACCT_ID", "SA_TYPE_CD", "CHAR_PREM_ID", "FINAL_REG_QTY",
                    "START_READ_DTTM", "END_READ_DTTM"]


def clean_bills(raw: DataFrame, p: Params = DEFAULT, columns: list[str] | None = None) -> DataFrame:
    """Cast, drop nulls, *then* keep last per BSEG_ID, *then* the length
    and service-type filters. The order matters: a bill whose last copy is
    out of range disappears. A copy that the filters drop takes part in the
    de-duplication by its key and order alone."""
    kept = (_bill_days(p).between(p.min_bill_days, p.max_bill_days)
            & F.col("SA_TYPE_CD").isin(*p.service_types))
    return with_volume_and_season(with_bill_days(dedup_bills(raw, p, columns, kept), p), p)


def summer_year(usage: DataFrame) -> DataFrame:
    """The earliest year with a summer bill, one row (null without
    any). The job takes it to the driver, so the window becomes a literal."""
    year = F.when(F.col("season") == "summer", F.year("END_READ_DTTM"))
    return usage.agg(F.min(year).cast("bigint").alias("summer_year"))


def season_medians(usage: DataFrame) -> DataFrame:
    """Exact medians of the normalised volume, one row per SP_ID."""
    med = exact_median(usage, ["SP_ID", "season"], "normalized_30day_kgal")
    return med.groupBy("SP_ID").agg(*(
        F.max(F.when(F.col("season") == s, F.col("median"))).alias(f"{s}_median_normalized_30day_kgal")
        for s in ("summer", "winter")))


def premise_lists(usage: DataFrame) -> DataFrame:
    """The distinct premises of a service point, sorted and joined. The
    distinct pairs come first, so a hot service point brings its premises, not its bills."""
    pairs = usage.where(F.col("CHAR_PREM_ID").isNotNull()).select("SP_ID", "CHAR_PREM_ID").distinct()
    return pairs.groupBy("SP_ID").agg(
        F.array_join(F.array_sort(F.collect_list("CHAR_PREM_ID")), "|").alias("CHAR_PREM_ID"))


STATS_COLUMNS = [
    "SP_ID", "Type", "CHAR_PREM_ID", "bill_type_count",
    "summer_bill_count", "summer_billed_daily_avg_kgal", "summer_triple_billed_daily_avg_kgal",
    "summer_mean_normalized_30day_kgal", "summer_median_normalized_30day_kgal",
    "winter_bill_count", "winter_mean_normalized_30day_kgal",
    "winter_median_normalized_30day_kgal",
]


def with_details(stats: DataFrame, usage: DataFrame) -> DataFrame:
    """Adds the premise list and the medians to one row per SP_ID."""
    return (stats.join(premise_lists(usage), "SP_ID", "left").join(season_medians(usage), "SP_ID", "left")
            .withColumn("CHAR_PREM_ID", F.coalesce("CHAR_PREM_ID", F.lit(""))).select(*STATS_COLUMNS))


def season_stats(usage: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per SP_ID with everything: D9-D14."""
    return with_details(season_base(usage, p), usage)


def season_base(usage: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per SP_ID: service code (D9), bill counts (D11), summer daily
    average and 3x threshold (D12, D13), season means (D14). One hash aggregate
    replaces four group-bys and three joins.

    A season without bills yields nulls, as if that SP were absent from the
    season's table. The distinct service-type count is the number of kept
    types present, since bills are filtered to those types first.
    """
    summer = F.col("season") == "summer"
    winter = F.col("season") == "winter"
    norm = F.col("normalized_30day_kgal")
    has = {t: F.bool_or(F.col("SA_TYPE_CD") == t) for t in p.service_types}
    g = usage.groupBy("SP_ID").agg(
        *[h.alias(f"_has_{t}") for t, h in has.items()],
        F.count_if(summer).cast("double").alias("_summer_rows"),
        F.sum(F.when(summer, F.col("FINAL_REG_QTY") * F.lit(p.ccf_to_kgal))).alias("_summer_kgal"),
        F.sum(F.when(summer, F.col("bill_days"))).alias("_summer_days"),
        F.avg(F.when(summer, norm)).alias("summer_mean_normalized_30day_kgal"),
        F.count_if(winter).cast("double").alias("_winter_rows"),
        F.avg(F.when(winter, norm)).alias("winter_mean_normalized_30day_kgal"),
    )
    type_count = sum((F.col(f"_has_{t}").cast("double") for t in p.service_types), F.lit(0.0))
    letters = [F.when(F.col(f"_has_{t}"), F.lit(letter)).otherwise(F.lit(""))
               for t, letter in p.service_letters]
    has_summer = F.col("_summer_rows") > 0
    daily = F.col("_summer_kgal") / F.col("_summer_days")
    g = g.withColumns({
        "Type": F.concat(*letters),
        "bill_type_count": type_count,
        "summer_bill_count": F.when(has_summer, F.col("_summer_rows") / type_count),
        "winter_bill_count": F.when(F.col("_winter_rows") > 0, F.col("_winter_rows") / type_count),
        "summer_billed_daily_avg_kgal": F.when(has_summer, daily),
        "summer_triple_billed_daily_avg_kgal": F.when(
            has_summer, F.greatest(daily * F.lit(p.threshold_multiple), F.lit(p.min_triple_daily_kgal))),
    })
    details = ("CHAR_PREM_ID", "summer_median_normalized_30day_kgal", "winter_median_normalized_30day_kgal")
    return g.select(*(c for c in STATS_COLUMNS if c not in details))


def screen(stats: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Summer mean > 3.0 and >= 2 x winter mean, both present (a filter
    on the fused aggregate, no join). Unrounded values are compared."""
    s = F.col("summer_mean_normalized_30day_kgal")
    w = F.col("winter_mean_normalized_30day_kgal")
    return stats.where(s.isNotNull() & w.isNotNull() & (s > F.lit(p.min_summer_mean_kgal))
                       & (s >= w * F.lit(p.summer_winter_ratio)))
