"""The weekly pivot (D28) and the zero-filled 26-week panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrosight.functions import round_half_even
from hydrosight.operators.dedup import union_keep_first
from hydrosight.params import DEFAULT, Params
from hydrosight.sources.schemas import METRIC_COLUMNS, THRESHOLD_COLUMNS, week_columns


def week_sums(day_ok: Column, p: Params = DEFAULT) -> list[Column]:
    """D28 as conditional sums in the same aggregate as D27: explicit week
    numbers give all 26 columns and leave week 27 (Sep 30) out."""
    return [F.sum(F.when(day_ok & (F.col("summer_week") == w), F.col("above_3x_day"))
                  .otherwise(F.lit(0.0))).alias(name)
            for w, name in enumerate(week_columns(p.week_count), start=1)]


def weekly_panel(thresholds: DataFrame, metrics: DataFrame, p: Params = DEFAULT,
                 candidates_only: bool = True) -> DataFrame:
    """Every candidate, with or without reads. Base = thresholds, and
    where the metrics are not reduced to candidates also the SPs that have
    metrics but no threshold; metrics and weeks left-joined, nulls -> 0.0 (NaN
    kept), rounded (D33)."""
    weeks = week_columns(p.week_count)
    base = thresholds.select("SP_ID", *THRESHOLD_COLUMNS)
    if not candidates_only:
        from_metrics = metrics.select("SP_ID").join(thresholds, "SP_ID", "left") \
            .select("SP_ID", *THRESHOLD_COLUMNS)
        base = union_keep_first([base, from_metrics], ["SP_ID"])
    panel = base.join(metrics.select("SP_ID", *METRIC_COLUMNS, *weeks), "SP_ID", "left")
    filled = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in METRIC_COLUMNS + weeks}
    panel = panel.withColumns(filled)
    rounded = {c: round_half_even(F.col(c), 4) for c in THRESHOLD_COLUMNS}
    rounded.update({c: round_half_even(F.col(c), 2) for c in METRIC_COLUMNS + weeks})
    return panel.withColumns(rounded).select("SP_ID", *THRESHOLD_COLUMNS, *METRIC_COLUMNS, *weeks)
