"""Raw input schemas: every column is text except the read quantities, which
arrive as numbers. ``_ord`` gives file order for keep-first/keep-last.

Fixed values: the column and counter names below belong to the job's input and
output contract and must be equal to it, in this order."""

from pyspark.sql import types as T

ORD = "_ord"

BILL_COLUMNS = [
    "BSEG_ID", "SP_ID", "SA_ID", "ACCT_ID", "SA_TYPE_CD", "CHAR_PREM_ID", "PREM_ID",
    "ADDRESS1", "FINAL_REG_QTY", "START_READ_DTTM", "END_READ_DTTM", "FINAL_UOM_CD",
]
PERSON_COLUMNS = ["ACCT_ID", "PER_ID", "ENTITY_NAME", "EMAILID", "PHONE_TYPE_CD", "PHONE"]
READ_COLUMNS = ["SP_ID", "BEGIN_READ_DTTM", "END_READ_DTTM", "CONSUMPTION", "UOM", "MULTIPLIER"]
PARCEL_COLUMNS = ["CIS_SP_ID", "LND_SQFOOT"]

_S = T.StringType()
RAW_READ_SCHEMA = T.StructType([
    T.StructField("SP_ID", _S), T.StructField("BEGIN_READ_DTTM", _S),
    T.StructField("END_READ_DTTM", _S), T.StructField("CONSUMPTION", T.DoubleType()),
    T.StructField("UOM", _S), T.StructField("MULTIPLIER", T.DoubleType()),
])

SUMMARY_COLUMNS = [
    "SP_ID", "ACCT_ID", "PER_ID", "ENTITY_NAME", "EMAILID", "PHONE_TYPE_CD", "PHONE",
    "Type", "CHAR_PREM_ID",
    "summer_bill_count", "summer_billed_daily_avg_kgal", "summer_triple_billed_daily_avg_kgal",
    "summer_mean_normalized_30day_kgal", "summer_median_normalized_30day_kgal",
    "summer_drc_coverage_days", "summer_drc_above_3x_days", "summer_drc_above_3x_intervals",
    "winter_bill_count", "winter_mean_normalized_30day_kgal",
    "winter_median_normalized_30day_kgal",
]

METRIC_COLUMNS = ["summer_drc_coverage_days", "summer_drc_above_3x_days",
                  "summer_drc_above_3x_intervals"]
THRESHOLD_COLUMNS = ["summer_billed_daily_avg_kgal", "summer_triple_billed_daily_avg_kgal"]


def week_columns(n: int) -> list[str]:
    return [f"week_{w:02d}" for w in range(1, n + 1)]


DIAGNOSTIC_COLUMNS = [
    "candidate_sp_ids", "raw_drc_rows", "raw_drc_sp_ids", "raw_supported_uom_rows",
    "raw_supported_uom_sp_ids", "prepared_drc_rows", "prepared_drc_sp_ids",
    "summer_overlap_drc_rows", "summer_overlap_drc_sp_ids",
    "summer_overlap_with_billed_threshold_sp_ids",
    "summer_overlap_without_billed_threshold_sp_ids", "summary_sp_ids",
    "summary_sp_ids_with_any_drc_coverage", "summary_sp_ids_with_drc_coverage_gt_170",
]
