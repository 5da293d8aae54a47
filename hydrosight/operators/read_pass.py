"""All interval-read work of the job in one pass over the reads.

The reads are by far the largest input (quarter-hour reads of every meter),
so they are scanned once: each read is cleaned, matched to its candidate
threshold, clipped, split over days and aggregated per (SP_ID, day), while
the same rows also feed the data-quality counters (D35), which need every
raw read. A read that is not a candidate's overlapping read stays one row
(with no day), so the split multiplies only reads that cross midnight.

Shuffles: one exchange by (SP_ID, day) after a partial aggregate (a meter
holding a third of all reads leaves each map task as at most one row per
day), then a small one by SP_ID. The candidate table joins by broadcast when
its counted bytes allow; else the reads of a heavy meter are spread over parts of the join key.

``read_rows`` -> ``read_days`` -> ``day_rows`` -> ``per_service_point``; the
named queries read the same steps as the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrosight.functions import strip_ws
from hydrosight.operators.intervals import (
    annotate_reads,
    clip_to_window,
    day_aggregates,
    day_flags,
    day_part,
    day_sequence,
    flag_above,
    prorate,
    summer_window,
    with_day_bounds,
    with_day_kgal,
)
from hydrosight.operators.joins import join_checked
from hydrosight.operators.panel import week_sums
from hydrosight.params import DEFAULT, Params
from hydrosight.sources.schemas import METRIC_COLUMNS, THRESHOLD_COLUMNS, week_columns

COUNT_COLUMNS = ["n_raw", "n_supported", "n_prepared", "n_overlap", "n_above"]


def read_rows(raw_reads: DataFrame, thresholds: DataFrame, thresholds_bytes: int,
              summer_year: int | None, p: Params = DEFAULT, candidates_only: bool = True) -> DataFrame:
    """One row per raw read, typed, with its threshold, the flags
    ``in_scope`` (survives cleaning, and belongs to a candidate unless
    ``candidates_only`` is off) and ``overlap`` (meets the window), and D17-D21."""
    r = annotate_reads(raw_reads, p)
    t = thresholds.select("SP_ID", *THRESHOLD_COLUMNS).withColumn("has_threshold", F.lit(True))
    r = join_checked(r, t, "SP_ID", "left", thresholds_bytes, "BEGIN_READ_DTTM", p,
                     keys=raw_reads.select(strip_ws("SP_ID").alias("SP_ID")))
    r = r.withColumn("has_threshold", F.coalesce("has_threshold", F.lit(False)))
    r = r.withColumn("in_scope", F.col("is_prepared") & F.col("has_threshold") if candidates_only
                     else F.col("is_prepared"))
    if summer_year is not None:
        r = clip_to_window(r, *summer_window(summer_year, p), p)
        overlap = F.col("in_scope") & (F.col("summer_overlap_days") > 0)
    else:
        r = r.withColumns({"summer_begin_dttm": F.lit(None).cast("timestamp_ntz"),
                           "summer_end_dttm": F.lit(None).cast("timestamp_ntz"),
                           "summer_overlap_days": F.lit(None).cast("double")})
        overlap = F.lit(False)
    # rows outside a candidate's overlap keep no denominators: their ratios
    # are null rather than a division by zero, and nothing reads them
    r = r.withColumn("overlap", F.coalesce(overlap, F.lit(False))).withColumns({
        "interval_days": F.when(F.col("overlap"), F.col("interval_days")),
        "summer_overlap_days": F.when(F.col("overlap"), F.col("summer_overlap_days")),
    })
    return flag_above(prorate(r, p))


def read_days(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """A row per overlapping read and calendar day (``_pos`` 0 first);
    any other read stays one row without a day."""
    days = F.when(F.col("overlap"), day_sequence(F.col("summer_begin_date"), F.col("summer_last_date"))) \
        .otherwise(F.array(F.lit(None).cast("date")))
    r = rows.select("*", F.posexplode(days).alias("_pos", "summer_date"))
    r = day_part(with_day_bounds(r), p)
    return r.withColumn("positive", F.coalesce(F.col("overlap") & (F.col("day_component_days") > 0), F.lit(False)))


def day_rows(days: DataFrame, summer_year: int | None, p: Params = DEFAULT) -> DataFrame:
    """D24-D26 and the read counters, one row per (SP_ID, day); ``day_ok`` marks
    the covered days. Thresholds depend on SP_ID only, so they ride along with
    ``max`` instead of widening the grouping key."""
    first = F.col("_pos") == 0
    g = days.groupBy("SP_ID", "summer_date").agg(
        F.count_if(first).alias("n_raw"),
        F.count_if(first & F.col("is_supported_unit")).alias("n_supported"),
        F.count_if(first & F.col("in_scope")).alias("n_prepared"),
        F.count_if(first & F.col("overlap")).alias("n_overlap"),
        F.count_if(first & F.col("overlap") & F.col("is_above_3x")).alias("n_above"),
        F.count_if("positive").alias("n_positive"),
        *day_aggregates(F.col("positive")),
        *[F.max(c).alias(c) for c in THRESHOLD_COLUMNS],
        F.max("has_threshold").alias("has_threshold"),
    )
    g = with_day_kgal(g)
    if summer_year is not None:
        g = day_flags(g, summer_window(summer_year, p)[0])
    else:
        g = g.withColumns({"above_3x_day": F.lit(0.0), "summer_week": F.lit(None).cast("bigint")})
    return g.withColumn("day_ok", F.col("summer_date").isNotNull() & (F.col("n_positive") > 0))


def per_service_point(days: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """D27, D28 and the counters, one row per raw (stripped) SP_ID."""
    ok = F.col("day_ok")
    return days.groupBy("SP_ID").agg(
        *[F.sum(c).alias(c) for c in COUNT_COLUMNS],
        F.max("has_threshold").alias("has_threshold"),
        F.count_if(ok).cast("double").alias("summer_drc_coverage_days"),
        F.sum(F.when(ok, F.col("above_3x_day"))).alias("summer_drc_above_3x_days"),
        F.sum("n_above").cast("double").alias("summer_drc_above_3x_intervals"),
        *week_sums(ok, p),
    )


def covered_metrics(stats: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The SPs with at least one covered day (the metric table of D27)."""
    return stats.where(F.col("summer_drc_coverage_days") > 0) \
        .select("SP_ID", *METRIC_COLUMNS, *week_columns(p.week_count))
