"""The named queries of the build plan, one per operator group.

Each takes ``(spark, sf_dir)``, derives the utility inputs from the
supplied tables (whole tables, no sampling) and returns a lazy DataFrame.
Doubles that come out of an aggregate are reported at fixed decimals (the
job's own 4 or 2, else 6): float sums depend on the order of addition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrosight.functions import report, round_half_even
from hydrosight.operators import bills as B
from hydrosight.operators import intervals as I
from hydrosight.operators.dedup import keep_first
from hydrosight.operators.people import clean_people, phone_type, sp_contacts
from hydrosight.operators.summary import SUMMARY_SORT
from hydrosight.params import DEFAULT, Params
from hydrosight.plans.job import build
from hydrosight.session import ensure_checkpoint_dir, materialize
from hydrosight.sources.csv import numbered, read_optional_csv, read_parcel_csv, read_raw_csv
from hydrosight.sources.schemas import (
    BILL_COLUMNS,
    ORD,
    PERSON_COLUMNS,
    RAW_READ_SCHEMA,
    READ_COLUMNS,
    THRESHOLD_COLUMNS,
    week_columns,
)
from hydrosight.sources.sinks import write_table
from hydrosight.sources.testdata import (
    Sources,
    raw_bills,
    raw_bills_in_order,
    raw_parcel,
    raw_person,
    raw_reads,
    testdata_sources,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def reg(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return reg


def _usage(spark, sf, columns=None) -> DataFrame:
    return B.clean_bills(raw_bills(spark, sf), DEFAULT, columns)


STATS_BILLS = ["BSEG_ID", "SP_ID", "SA_TYPE_CD", "FINAL_REG_QTY", "START_READ_DTTM", "END_READ_DTTM"]


def _stats(spark, sf) -> DataFrame:
    return B.season_base(_usage(spark, sf, STATS_BILLS))


# ---------------------------------------------------------------- bills --
@query("clean_bills")
def q_clean_bills(spark, sf):
    return _usage(spark, sf).select(*BILL_COLUMNS, "bill_days", "normalized_30day_kgal", "season")


@query("dedup_keep_last")
def q_dedup_keep_last(spark, sf):
    return B.dedup_bills(raw_bills(spark, sf)).select(*BILL_COLUMNS)


@query("dedup_keep_first")
def q_dedup_keep_first(spark, sf):
    return keep_first(raw_person(spark, sf), ["ACCT_ID", "PER_ID"]).select(*PERSON_COLUMNS)


@query("normalised_volume")
def q_normalised_volume(spark, sf):
    return _usage(spark, sf, STATS_BILLS).select("BSEG_ID", "SP_ID", "bill_days", "normalized_30day_kgal")


@query("season_tag")
def q_season_tag(spark, sf):
    return _usage(spark, sf, STATS_BILLS).select("BSEG_ID", "END_READ_DTTM",
                                    F.month("END_READ_DTTM").cast("bigint").alias("end_month"), "season")


@query("timestamp_parse")
def q_timestamp_parse(spark, sf):
    t = B.typed_bills(raw_bills(spark, sf))
    return t.select(
        F.col("BSEG_ID"), "START_READ_DTTM", "END_READ_DTTM",
        F.col("END_READ_DTTM").cast("date").alias("end_date"),
        F.col("END_READ_DTTM").cast("date").cast("timestamp_ntz").alias("end_midnight"),
        F.col("END_READ_DTTM").cast("string").alias("end_text"),
    )


@query("service_code")
def q_service_code(spark, sf):
    return _stats(spark, sf).select("SP_ID", "Type")


@query("premise_list")
def q_premise_list(spark, sf):
    usage = _usage(spark, sf, ["BSEG_ID", "SP_ID", "CHAR_PREM_ID", "SA_TYPE_CD", "FINAL_REG_QTY", "START_READ_DTTM",
                               "END_READ_DTTM"])
    every = usage.select("SP_ID").distinct().join(B.premise_lists(usage), "SP_ID", "left")
    return every.select("SP_ID", F.coalesce("CHAR_PREM_ID", F.lit("")).alias("CHAR_PREM_ID"))


@query("bill_counts")
def q_bill_counts(spark, sf):
    return _stats(spark, sf).select("SP_ID", "bill_type_count", "summer_bill_count", "winter_bill_count")


@query("summer_threshold")
def q_summer_threshold(spark, sf):
    s = _stats(spark, sf).where(F.col("summer_bill_count").isNotNull())
    return s.select("SP_ID", *[round_half_even(F.col(c), 4).alias(c) for c in THRESHOLD_COLUMNS])


@query("season_stats")
def q_season_stats(spark, sf):
    cols = ["summer_mean_normalized_30day_kgal", "summer_median_normalized_30day_kgal",
            "winter_mean_normalized_30day_kgal", "winter_median_normalized_30day_kgal"]
    usage = materialize(_usage(spark, sf, STATS_BILLS))  # means and medians read it
    stats = B.season_base(usage).join(B.season_medians(usage), "SP_ID", "left")
    return stats.select("SP_ID", *[round_half_even(F.col(c), 2).alias(c) for c in cols])


@query("candidate_screen")
def q_candidate_screen(spark, sf):
    return B.screen(_stats(spark, sf)).select("SP_ID")


@query("summer_year")
def q_summer_year(spark, sf):
    return B.summer_year(_usage(spark, sf, STATS_BILLS))


# --------------------------------------------------------------- people --
@query("phone_types")
def q_phone_types(spark, sf):
    r = raw_person(spark, sf)
    return r.select(F.col("PHONE_TYPE_CD").alias("raw_phone_type_cd"),
                    phone_type("PHONE_TYPE_CD").alias("PHONE_TYPE_CD")).distinct()


@query("clean_people")
def q_clean_people(spark, sf):
    return clean_people(raw_person(spark, sf)).select(*PERSON_COLUMNS)


@query("sp_contacts")
def q_sp_contacts(spark, sf):
    usage = _usage(spark, sf, ["BSEG_ID", "SP_ID", "ACCT_ID", "SA_TYPE_CD", "FINAL_REG_QTY", "START_READ_DTTM",
                               "END_READ_DTTM"])
    return sp_contacts(usage, clean_people(raw_person(spark, sf)))


# ---------------------------------------------------------------- reads --
@query("clean_intervals")
def q_clean_intervals(spark, sf):
    return I.clean_intervals(raw_reads(spark, sf))


@query("unit_conversion")
def q_unit_conversion(spark, sf):
    a = I.annotate_reads(raw_reads(spark, sf))
    return a.select("SP_ID", "BEGIN_READ_DTTM", "UOM", "CONSUMPTION", "MULTIPLIER", "interval_kgal")


READ_KEY = ["SP_ID", "BEGIN_READ_DTTM", "END_READ_DTTM"]


@query("interval_clip")
def q_interval_clip(spark, sf):
    r = _job(spark, sf).reads.where("overlap")
    return r.select(*READ_KEY, "summer_begin_dttm", "summer_end_dttm", "summer_overlap_days")


@query("interval_prorate")
def q_interval_prorate(spark, sf):
    r = _job(spark, sf).reads.where("overlap")
    return r.select(*READ_KEY, "summer_interval_kgal", "summer_drc_daily_kgal", "is_subdaily_interval",
                    "summer_begin_date", "summer_last_date")


@query("interval_above")
def q_interval_above(spark, sf):
    return _job(spark, sf).stats.where("n_overlap > 0").select("SP_ID", "summer_drc_above_3x_intervals")


@query("day_split")
def q_day_split(spark, sf):
    d = _job(spark, sf).days.where("overlap")
    return d.select(*READ_KEY, "summer_date", "day_start_dttm", "day_end_dttm")


@query("day_parts")
def q_day_parts(spark, sf):
    return _job(spark, sf).days.where("positive").select(*READ_KEY, "summer_date", "day_component_days",
                                                         "day_component_kgal")


def _reconciled(days: DataFrame) -> DataFrame:
    return days.where("day_ok").select(
        "SP_ID", "summer_date", "has_subdaily_detail",
        *[report(F.col(c)).alias(c) for c in ("subdaily_day_kgal", "daily_day_kgal", "summer_daily_kgal")])


@query("day_reconcile")
def q_day_reconcile(spark, sf):
    return _reconciled(_job(spark, sf).day_table)


@query("day_reconcile_shuffled")
def q_day_reconcile_shuffled(spark, sf):
    """The plan for candidates that are too many to broadcast: meters split over parts."""
    return _reconciled(_job(spark, sf, p=Params(broadcast_max_bytes=-1)).day_table)


@query("day_above")
def q_day_above(spark, sf):
    return _job(spark, sf).day_table.where("day_ok").select("SP_ID", "summer_date", "above_3x_day")


@query("summer_week")
def q_summer_week(spark, sf):
    d = _job(spark, sf).day_table.where("day_ok")
    return d.groupBy("SP_ID", "summer_week").agg(F.sum("above_3x_day").alias("above_3x_days"))


@query("coverage_metrics")
def q_coverage_metrics(spark, sf):
    return _job(spark, sf).metrics.select("SP_ID", "summer_drc_coverage_days", "summer_drc_above_3x_days",
                                          "summer_drc_above_3x_intervals")


@query("weekly_pivot")
def q_weekly_pivot(spark, sf):
    return _job(spark, sf).metrics.select("SP_ID", *week_columns(DEFAULT.week_count))


# ---------------------------------------------------------------- files --
def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/hydrosight-files/{name}-{uuid.uuid4().hex}"


#: rows in a compressed file, which one task reads: some 30 MB of text
FILE_ROWS = 300_000


def _csv_copy(spark, raw: DataFrame, columns: list[str], name: str, header=str) -> str:
    """The raw table as gzipped CSV files whose order is ``_ord`` (without that column: its own), with folded header."""
    path = _folder(spark, name)
    out = raw.orderBy(ORD) if ORD in raw.columns else raw
    write_table(out.select(*[F.col(c).alias(header(c)) for c in columns]), path, fmt="csv",
                compression="gzip", max_rows=FILE_ROWS)
    return path


@query("csv_clean_bills")
def q_csv_clean_bills(spark, sf):
    """Bills through CSV files with a lower-case header; file order decides keep-last."""
    path = _csv_copy(spark, raw_bills_in_order(spark, sf), BILL_COLUMNS, "bills", str.lower)
    # an empty address is an empty field, which reads as null (S3)
    return B.clean_bills(read_raw_csv(spark, path)).withColumn("ADDRESS1", F.coalesce("ADDRESS1", F.lit(""))).select(
        *BILL_COLUMNS, "bill_days", "normalized_30day_kgal", "season")


@query("csv_clean_people")
def q_csv_clean_people(spark, sf):
    path = _csv_copy(spark, raw_person(spark, sf), PERSON_COLUMNS, "person", str.lower)
    return clean_people(read_raw_csv(spark, path)).select(*PERSON_COLUMNS)


@query("csv_clean_intervals")
def q_csv_clean_intervals(spark, sf):
    """The optional read files, as text."""
    path = _csv_copy(spark, raw_reads(spark, sf), READ_COLUMNS, "reads")
    return I.clean_intervals(read_optional_csv(spark, path, RAW_READ_SCHEMA, with_order=False))


@query("panel_absent_reads")
def q_panel_absent_reads(spark, sf):
    """Read and parcel files that are not there."""
    src = testdata_sources(spark, sf)
    empty = _folder(spark, "no-reads")
    reads = read_optional_csv(spark, [empty, f"{empty}/*.csv"], RAW_READ_SCHEMA, with_order=False)
    return build(spark, Sources(src.bills, src.person, reads, read_parcel_csv(spark, empty))).panel


@query("timestamp_inferred")
def q_timestamp_inferred(spark, sf):
    """Bills whose columns are written in two other forms, found from the data."""
    raw = raw_bills(spark, sf)
    start, end = (F.col(c).cast("timestamp_ntz") for c in ("START_READ_DTTM", "END_READ_DTTM"))
    raw = raw.withColumns({"START_READ_DTTM": F.date_format(start, "MM/dd/yyyy HH:mm"),
                           "END_READ_DTTM": F.date_format(end, "dd-MM-yyyy HH:mm:ss")})
    usage = B.clean_bills(raw, Params(ts_format="infer"))
    return usage.select(*BILL_COLUMNS, "bill_days", "normalized_30day_kgal", "season")


@query("csv_quoted_newlines")
def q_csv_quoted_newlines(spark, sf):
    """A folder of Latin-1 files, some with quoted newlines, read without a flag. Names hold
    a letter above 127 and no-break spaces around, which stripping removes (X1)."""
    raw = raw_person(spark, sf)
    name = F.concat(F.lit("\u00a0"), "ENTITY_NAME", F.lit(" \u00e9\u00a0"))
    path = _folder(spark, "person-mixed")
    odd = F.substring("PER_ID", -1, 1) == "B"
    for rows, text in ((raw.where(odd), F.concat(name, F.lit("\n2nd line"))), (raw.where(~odd), name)):
        out = rows.withColumn("ENTITY_NAME", text).orderBy(ORD).select(*PERSON_COLUMNS)
        write_table(out, path, fmt="csv", mode="append", encoding="ISO-8859-1")
    return clean_people(read_raw_csv(spark, path, multiline=None)).select(*PERSON_COLUMNS)


def _csv_sources(spark, sf):
    src = testdata_sources(spark, sf, with_parcel=True)
    parcel = src.parcel.withColumn("OTHER", F.lit("wide"))
    src.parcel = read_parcel_csv(spark, _csv_copy(spark, parcel, ["CIS_SP_ID", "OTHER", "LND_SQFOOT"], "parcel"))
    return src


@query("csv_summary")
def q_csv_summary(spark, sf):
    """The summary with parcels from CSV, written as sorted CSV and read back."""
    summary = build(spark, _csv_sources(spark, sf)).summary
    path = _folder(spark, "summary")
    write_table(summary, path, fmt="csv", sort_by=SUMMARY_SORT)
    texts = {c for c, t in summary.dtypes if t == "string"}
    back = read_raw_csv(spark, path, encoding="UTF-8", with_order=False, fold_header=False)
    # an empty premise list and a missing text are both empty fields
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) if c == "CHAR_PREM_ID" else
                         F.col(c) if c in texts else F.col(c).cast("double") for c in summary.columns])


@query("csv_panel")
def q_csv_panel(spark, sf):
    """The panel written as sorted CSV and read back."""
    panel = _job(spark, sf).panel
    path = _folder(spark, "panel")
    write_table(panel, path, fmt="csv", sort_by=["SP_ID"])
    back = read_raw_csv(spark, path, encoding="UTF-8", with_order=False, fold_header=False)
    return back.select("SP_ID", *[F.col(c).cast("double") for c in panel.columns[1:]])


@query("csv_summary_order")
def q_csv_summary_order(spark, sf):
    """O1: the place of each row in the sorted files, read in the order of their names."""
    path = _folder(spark, "summary-order")
    write_table(build(spark, _csv_sources(spark, sf)).summary, path, fmt="csv", sort_by=SUMMARY_SORT)
    return numbered(read_raw_csv(spark, path, encoding="UTF-8")).select(*SUMMARY_SORT, "row_no")


@query("csv_panel_order")
def q_csv_panel_order(spark, sf):
    """The place of each row in the one file that sorted parts were joined to."""
    path = _folder(spark, "panel-order")
    write_table(_job(spark, sf).panel, path, fmt="csv", sort_by=["SP_ID"], single_file=True)
    return numbered(read_raw_csv(spark, path, encoding="UTF-8")).select("SP_ID", "row_no")


# ------------------------------------------------------------ job-level --
def _job(spark, sf, reads=True, parcel=False, p: Params = DEFAULT, candidates_only=True):
    return build(spark, testdata_sources(spark, sf, with_reads=reads, with_parcel=parcel), p, candidates_only)


@query("weekly_panel")
def q_weekly_panel(spark, sf):
    return _job(spark, sf).panel


@query("weekly_panel_no_reads")
def q_weekly_panel_no_reads(spark, sf):
    return _job(spark, sf, reads=False).panel


@query("summary")
def q_summary(spark, sf):
    return _job(spark, sf).summary


@query("summary_with_parcel")
def q_summary_with_parcel(spark, sf):
    return _job(spark, sf, parcel=True).summary


@query("diagnostics")
def q_diagnostics(spark, sf):
    return _job(spark, sf).diagnostics


@query("coverage_report")
def q_coverage_report(spark, sf):
    return _job(spark, sf).report


@query("diagnostics_all_reads")
def q_diagnostics_all_reads(spark, sf):
    """D35 on reads that are not reduced to candidates: service points without a threshold count."""
    return _job(spark, sf, candidates_only=False).diagnostics


@query("weekly_panel_all_reads")
def q_weekly_panel_all_reads(spark, sf):
    """D29 with service points that have metrics but no threshold (union, first wins)."""
    return _job(spark, sf, candidates_only=False).panel
