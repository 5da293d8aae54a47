"""Meter interval reads, the steps of ``read_pass``: cleaning (D7, D8), the
summer window (D16), clip and prorate (D17-D21), split over calendar days (D22,
D23), reconcile sub-daily against daily reads (D24) and the day flags (D25, D26).
Every step here is a narrow expression."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrosight.functions import days_between, strip_ws
from hydrosight.operators.parse import typed
from hydrosight.params import DEFAULT, Params
from hydrosight.sources.schemas import READ_COLUMNS


def _one_micro() -> Column:
    return F.expr("INTERVAL '0.000001' SECOND")


def _one_day() -> Column:
    return F.expr("INTERVAL 1 DAY")


def annotate_reads(raw: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Typed reads with the D7/D8 outcome as flags instead of filters:
    ``is_supported_unit`` (raw unit CCF/GAL) and ``is_prepared`` (the row
    survives cleaning). Parsing is strict for every row."""
    df = typed(raw.select(*READ_COLUMNS), ["BEGIN_READ_DTTM", "END_READ_DTTM"], ["CONSUMPTION", "MULTIPLIER"], p)
    df = df.withColumns({
        "SP_ID": strip_ws("SP_ID"),
        "UOM": F.upper(strip_ws("UOM")),
        "MULTIPLIER": F.coalesce("MULTIPLIER", F.lit(1.0)),
    })
    days = days_between("END_READ_DTTM", "BEGIN_READ_DTTM", p.seconds_per_day)
    kgal = (F.when(F.col("UOM").isin(*p.ccf_units),
                   F.col("CONSUMPTION") * F.col("MULTIPLIER") * F.lit(p.ccf_to_kgal))
            .when(F.col("UOM").isin(*p.gal_units),
                  F.col("CONSUMPTION") * F.col("MULTIPLIER") * F.lit(p.gal_to_kgal)))
    df = df.withColumns({"interval_days": days, "interval_kgal": kgal})
    prepared = (F.col("SP_ID").isNotNull() & F.col("BEGIN_READ_DTTM").isNotNull()
                & F.col("END_READ_DTTM").isNotNull() & F.col("CONSUMPTION").isNotNull()
                & (F.col("END_READ_DTTM") > F.col("BEGIN_READ_DTTM"))
                & F.col("interval_days").isNotNull() & F.col("interval_kgal").isNotNull()
                & (F.col("interval_days") > 0))
    return df.withColumns({
        "is_supported_unit": F.coalesce(F.col("UOM").isin(*p.supported_units), F.lit(False)),
        "is_prepared": F.coalesce(prepared, F.lit(False)),
    })


def clean_intervals(raw: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """D7 + D8: the reads that survive cleaning. Reads are never de-duplicated."""
    return (annotate_reads(raw, p).where(F.col("is_prepared"))
            .drop("is_prepared", "is_supported_unit"))


def summer_window(year: int, p: Params = DEFAULT) -> tuple[_dt.date, _dt.date]:
    """[Apr 1, Oct 1) of the earliest summer year."""
    return _dt.date(year, p.summer_start_month, 1), _dt.date(year, p.summer_end_month, 1)


def _ntz(d: _dt.date) -> Column:
    return F.lit(d).cast("timestamp_ntz")


def clip_to_window(reads: DataFrame, start: _dt.date, end: _dt.date,
                   p: Params = DEFAULT) -> DataFrame:
    """Clip each read to the window; overlap in whole seconds / 86400."""
    df = reads.withColumns({
        "summer_begin_dttm": F.greatest(F.col("BEGIN_READ_DTTM"), _ntz(start)),
        "summer_end_dttm": F.least(F.col("END_READ_DTTM"), _ntz(end)),
    })
    return df.withColumn("summer_overlap_days",
                         days_between("summer_end_dttm", "summer_begin_dttm", p.seconds_per_day))


def prorate(clipped: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Kgal inside the window, its daily rate, the sub-daily flag and
    the first/last calendar day touched (end minus 1 us: half-open)."""
    df = clipped.withColumns({
        "summer_interval_kgal": F.col("interval_kgal") * F.col("summer_overlap_days")
        / F.col("interval_days"),
        "is_subdaily_interval": F.col("interval_days") < F.lit(p.subdaily_cut_days),
        "summer_begin_date": F.col("summer_begin_dttm").cast("date"),
        "summer_last_date": (F.col("summer_end_dttm") - _one_micro()).cast("date"),
    })
    return df.withColumn("summer_drc_daily_kgal",
                         F.col("summer_interval_kgal") / F.col("summer_overlap_days"))


def above_flag(rate: Column, threshold: Column) -> Column:
    """Above the 3x threshold; no threshold means not above."""
    return F.when(threshold.isNotNull(), rate > threshold).otherwise(F.lit(False))


def flag_above(prorated: DataFrame) -> DataFrame:
    return prorated.withColumn(
        "is_above_3x", above_flag(F.col("summer_drc_daily_kgal"),
                                  F.col("summer_triple_billed_daily_avg_kgal")))


def day_sequence(begin_date: Column, last_date: Column) -> Column:
    """Every calendar day from begin to last, both included. Guarded so
    a reversed pair gives no day (Spark's sequence would count down)."""
    return F.when(begin_date <= last_date, F.sequence(begin_date, last_date)) \
        .otherwise(F.array().cast("array<date>"))


def with_day_bounds(df: DataFrame) -> DataFrame:
    df = df.withColumn("day_start_dttm", F.col("summer_date").cast("timestamp_ntz"))
    return df.withColumn("day_end_dttm", F.col("day_start_dttm") + _one_day())


def day_part(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The part of the read inside its day, in whole seconds, and the
    kgal prorated to it (not yet filtered)."""
    df = df.withColumns({
        "day_component_begin_dttm": F.greatest(F.col("summer_begin_dttm"), F.col("day_start_dttm")),
        "day_component_end_dttm": F.least(F.col("summer_end_dttm"), F.col("day_end_dttm")),
    })
    df = df.withColumn("day_component_days", days_between(
        "day_component_end_dttm", "day_component_begin_dttm", p.seconds_per_day))
    return df.withColumn("day_component_kgal", F.col("interval_kgal") * F.col("day_component_days")
                         / F.col("interval_days"))


def day_aggregates(positive: Column) -> list[Column]:
    """D24 partial sums over the parts of one (SP_ID, day): the sub-daily reads
    win when any touches the day, else the daily-or-longer ones."""
    sub = F.col("is_subdaily_interval")
    kgal = F.col("day_component_kgal")
    return [
        F.coalesce(F.bool_or(positive & sub), F.lit(False)).alias("has_subdaily_detail"),
        F.sum(F.when(positive & sub, kgal).otherwise(F.lit(0.0))).alias("subdaily_day_kgal"),
        F.sum(F.when(positive & ~sub, kgal).otherwise(F.lit(0.0))).alias("daily_day_kgal"),
    ]


def with_day_kgal(g: DataFrame) -> DataFrame:
    return g.withColumn("summer_daily_kgal", F.when(F.col("has_subdaily_detail"),
                                                    F.col("subdaily_day_kgal"))
                        .otherwise(F.col("daily_day_kgal")))


def day_flags(days: DataFrame, start: _dt.date) -> DataFrame:
    """D25 (day above 3x, as 0.0/1.0) and D26 (summer week; Sep 30 is week 27)."""
    return days.withColumns({
        "above_3x_day": above_flag(F.col("summer_daily_kgal"),
                                   F.col("summer_triple_billed_daily_avg_kgal")).cast("double"),
        "summer_week": summer_week(F.col("summer_date"), start),
    })


def summer_week(day: Column, start: _dt.date) -> Column:
    return (F.floor(F.datediff(day, F.lit(start)) / F.lit(7.0)).cast("bigint") + F.lit(1)).cast("bigint")
