"""The 14 data-quality counters (D35) and the run report.

All counters come from aggregates over per-SP tables (the read pass already
reduced the reads to one row per meter), so each is one small job; distinct
counts become counts of per-SP rows and need no distinct aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrosight.params import DEFAULT, Params
from hydrosight.sources.schemas import DIAGNOSTIC_COLUMNS


def _big(c):
    return F.coalesce(c, F.lit(0)).cast("bigint")


def read_counters(read_stats: DataFrame) -> DataFrame:
    """Counters 2-11 from the per-SP read table (1 row)."""
    sp = F.col("SP_ID").isNotNull()
    ovl = F.col("n_overlap") > 0
    return read_stats.agg(
        _big(F.sum("n_raw")).alias("raw_drc_rows"),
        _big(F.count_if(sp)).alias("raw_drc_sp_ids"),
        _big(F.sum("n_supported")).alias("raw_supported_uom_rows"),
        _big(F.count_if(sp & (F.col("n_supported") > 0))).alias("raw_supported_uom_sp_ids"),
        _big(F.sum("n_prepared")).alias("prepared_drc_rows"),
        _big(F.count_if(F.col("n_prepared") > 0)).alias("prepared_drc_sp_ids"),
        _big(F.sum("n_overlap")).alias("summer_overlap_drc_rows"),
        _big(F.count_if(ovl)).alias("summer_overlap_drc_sp_ids"),
        _big(F.count_if(ovl & F.col("has_threshold"))).alias("summer_overlap_with_billed_threshold_sp_ids"),
        _big(F.count_if(ovl & ~F.col("has_threshold"))).alias("summer_overlap_without_billed_threshold_sp_ids"),
    )


def summary_counters(coverage: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Counters 12-14 from (SP_ID, summer_drc_coverage_days) of the summary's
    rows: distinct SPs, and those with coverage > 0 and > 170 days (coverage is
    per SP, so max over its rows is its value)."""
    per_sp = coverage.groupBy("SP_ID").agg(F.max("summer_drc_coverage_days").alias("cov"))
    return per_sp.agg(
        _big(F.count(F.lit(1))).alias("summary_sp_ids"),
        _big(F.count_if(F.col("cov") > 0)).alias("summary_sp_ids_with_any_drc_coverage"),
        _big(F.count_if(F.col("cov") > F.lit(p.coverage_report_days)))
        .alias("summary_sp_ids_with_drc_coverage_gt_170"),
    )


def _long(wide: DataFrame) -> DataFrame:
    cols = [c for c in wide.columns]
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in cols
    ])).alias("r")).select("r.*")


def diagnostic_rows(candidate_count: int, read_stats: DataFrame | None, coverage: DataFrame,
                    p: Params = DEFAULT) -> DataFrame:
    """D35 in long form: (metric, value) rows, from three small aggregates."""
    spark = coverage.sparkSession
    parts = [spark.range(1).select(F.lit(candidate_count).cast("bigint").alias("candidate_sp_ids"))]
    if read_stats is None:
        parts.append(spark.range(1).select(
            *[F.lit(0).cast("bigint").alias(c) for c in DIAGNOSTIC_COLUMNS[1:11]]))
    else:
        parts.append(read_counters(read_stats))
    parts.append(summary_counters(coverage, p))
    out = _long(parts[0])
    for part in parts[1:]:
        out = out.unionByName(_long(part))
    return out


def diagnostics(rows: DataFrame) -> DataFrame:
    """D35 as one row of 14 bigints, in the fixed counter order (a pivot of
    the long form with explicit values)."""
    return rows.groupBy().pivot("metric", DIAGNOSTIC_COLUMNS).agg(F.max("value")) \
        .select(*[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in DIAGNOSTIC_COLUMNS])


def coverage_report(rows: DataFrame, source_rows: dict[str, int] | None = None) -> DataFrame:
    """D36 + S10/S11: the counters as (metric, value) rows for the run log,
    plus the row count of each source, which the job counted as it read them."""
    counts = [(f"{name}_rows", n) for name, n in (source_rows or {}).items()]
    if not counts:
        return rows
    return rows.unionByName(rows.sparkSession.createDataFrame(counts, "metric string, value bigint"))
