"""Independent DuckDB SQL for every named query.

Written step by step in the order the screening rules state them (separate
summer and winter tables, window-function de-duplication, a literal day
split), so it also checks the fused Spark plans. The supplied tables are
pre-registered views; the utility inputs are derived by the same fixed
rules as ``hydrosight.sources.testdata``.
"""

from __future__ import annotations

from hydrosight.functions.columns import WHITESPACE
from hydrosight.sources.schemas import DIAGNOSTIC_COLUMNS, SUMMARY_COLUMNS, week_columns

WS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
TS = "'%Y-%m-%d %H:%M:%S'"
WEEKS = week_columns(26)


def strip(c: str) -> str:
    return f"trim({c}, {WS})"


def r(c: str, d: int) -> str:
    return f"round_even(({c}) * 1e{d}, 0) / 1e{d}"


FIXTURES = f"""
raw_consumption AS (
  SELECT
    CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS BSEG_ID,
    ' SP' || printf('%07d', o.o_custkey) AS SP_ID,
    CAST(l.l_suppkey AS VARCHAR) AS SA_ID,
    'A' || printf('%07d', o.o_custkey + CASE WHEN l.l_linenumber = 7 THEN 1 ELSE 0 END) || ' ' AS ACCT_ID,
    CASE l.l_returnflag || l.l_linestatus WHEN 'AF' THEN ' wres ' WHEN 'AO' THEN 'WRES'
      WHEN 'NF' THEN 'WRESSEW' WHEN 'NO' THEN 'WRESIRR' WHEN 'RF' THEN 'WRECRES' ELSE 'ERES' END AS SA_TYPE_CD,
    CASE WHEN l.l_partkey % 10 = 0 THEN NULL ELSE 'P' || CAST(o.o_custkey + l.l_partkey % 2 AS VARCHAR) END AS CHAR_PREM_ID,
    'P' || CAST(o.o_custkey AS VARCHAR) AS PREM_ID,
    '' AS ADDRESS1,
    CAST(l.l_quantity * CASE WHEN month(l.end_day) BETWEEN 4 AND 9 AND o.o_custkey % 3 = 0 THEN 4 ELSE 1 END AS VARCHAR) AS FINAL_REG_QTY,
    strftime(CAST(l.end_day - CAST(18 + l.l_partkey % 25 AS INTEGER) AS TIMESTAMP), {TS}) AS START_READ_DTTM,
    strftime(CAST(l.end_day AS TIMESTAMP), {TS}) AS END_READ_DTTM,
    'CCF' AS FINAL_UOM_CD,
    l.end_day AS o1, l.l_partkey AS o2, l.l_suppkey AS o3, l.l_quantity AS o4,
    l.l_extendedprice AS o5, l.l_discount AS o6, l.l_tax AS o7
  FROM (SELECT *, DATE '2024-03-15'
          + CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) % 365 AS INTEGER) AS end_day
        FROM lineitem) l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
),
cust_p AS (
  SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 11 IN (0, 1) THEN 'N' ELSE 'A' END AS a,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'mob' WHEN 'BUILDING' THEN ' HM ' WHEN 'FURNITURE' THEN 'Business'
      WHEN 'HOUSEHOLD' THEN 'CEL' WHEN 'MACHINERY' THEN 'fax' END AS ptype
  FROM customer
),
raw_person AS (
  SELECT a || printf('%07d', k) AS ACCT_ID, 'R' || CAST(k AS VARCHAR) AS PER_ID,
    c_name AS ENTITY_NAME, 'USER' || CAST(k AS VARCHAR) || '@EXAMPLE.ORG' AS EMAILID, ptype AS PHONE_TYPE_CD,
    '555-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS PHONE, 0 AS ord FROM cust_p
  UNION ALL
  SELECT a || printf('%07d', k), 'R' || CAST(k AS VARCHAR), c_name,
    'USER' || CAST(k AS VARCHAR) || '@EXAMPLE.ORG', ptype, '555-DUP', 1 FROM cust_p WHERE k % 7 = 0
  UNION ALL
  SELECT a || printf('%07d', k), 'R' || CAST(k AS VARCHAR) || 'B', c_name,
    'USER' || CAST(k AS VARCHAR) || '@EXAMPLE.ORG', ptype,
    '555-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0'), 2 FROM cust_p WHERE k % 5 = 0
),
ev_b AS (
  SELECT *, TIMESTAMP '2024-03-20'
      + to_hours(CAST((7 * date_sub('second', TIMESTAMP '2024-01-01', ts)) // 3600 AS BIGINT)) AS b,
    CASE event_type WHEN 'click' THEN 15 WHEN 'view' THEN 60 WHEN 'purchase' THEN 1440
      WHEN 'signup' THEN 28800 ELSE 0 END AS mins,
    CASE WHEN event_id % 5 IN (0, 1) THEN 'CCF' WHEN event_id % 5 IN (2, 3) THEN 'GAL' ELSE 'XX' END AS unit
  FROM events
),
raw_drc AS (
  SELECT 'SP' || printf('%07d', user_id) AS SP_ID,
    strftime(b, {TS}) AS BEGIN_READ_DTTM,
    strftime(b + to_minutes(CAST(mins AS BIGINT)), {TS}) AS END_READ_DTTM,
    CASE WHEN unit = 'GAL' THEN value * 748 ELSE value END AS CONSUMPTION,
    unit AS UOM,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE 1e0 END AS MULTIPLIER
  FROM ev_b
),
raw_parcel AS (
  SELECT CASE WHEN c_custkey % 4 = 0 THEN 'NP' ELSE 'SP' END || printf('%07d', c_custkey) AS CIS_SP_ID, 5000e0 + abs(c_acctbal) AS LND_SQFOOT, 0 AS ord
  FROM customer
  UNION ALL
  SELECT CASE WHEN c_custkey % 4 = 0 THEN 'NP' ELSE 'SP' END || printf('%07d', c_custkey), 5000e0 + abs(c_acctbal) + 1, 1
  FROM customer WHERE c_custkey % 6 = 0
)"""

STEPS = f"""
typed_bills AS (
  SELECT {strip('BSEG_ID')} AS BSEG_ID, {strip('SP_ID')} AS SP_ID, {strip('SA_ID')} AS SA_ID,
    {strip('ACCT_ID')} AS ACCT_ID, upper({strip('SA_TYPE_CD')}) AS SA_TYPE_CD,
    {strip('CHAR_PREM_ID')} AS CHAR_PREM_ID, {strip('PREM_ID')} AS PREM_ID, {strip('ADDRESS1')} AS ADDRESS1,
    CAST(FINAL_REG_QTY AS DOUBLE) AS FINAL_REG_QTY,
    strptime(START_READ_DTTM, {TS}) AS START_READ_DTTM, strptime(END_READ_DTTM, {TS}) AS END_READ_DTTM,
    upper({strip('FINAL_UOM_CD')}) AS FINAL_UOM_CD, o1, o2, o3, o4, o5, o6, o7
  FROM raw_consumption
),
dedup_bills AS (
  SELECT * FROM typed_bills
  WHERE BSEG_ID IS NOT NULL AND SP_ID IS NOT NULL AND SA_ID IS NOT NULL AND ACCT_ID IS NOT NULL
    AND SA_TYPE_CD IS NOT NULL AND FINAL_REG_QTY IS NOT NULL AND START_READ_DTTM IS NOT NULL
    AND END_READ_DTTM IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY BSEG_ID
    ORDER BY o1 DESC, o2 DESC, o3 DESC, o4 DESC, o5 DESC, o6 DESC, o7 DESC) = 1
),
bills_days AS (
  SELECT * EXCLUDE (o1, o2, o3, o4, o5, o6, o7),
    date_sub('second', START_READ_DTTM, END_READ_DTTM) / 86400e0 AS bill_days
  FROM dedup_bills
),
usage AS (
  SELECT *, FINAL_REG_QTY * 7.480519e-1 * 30e0 / bill_days AS normalized_30day_kgal,
    CASE WHEN month(END_READ_DTTM) IN (4, 5, 6, 7, 8, 9) THEN 'summer' ELSE 'winter' END AS season
  FROM bills_days
  WHERE bill_days BETWEEN 20e0 AND 40e0 AND SA_TYPE_CD IN ('WRES', 'WRESSEW', 'WRESIRR', 'WRECRES')
),
people AS (
  SELECT ACCT_ID, PER_ID, ENTITY_NAME, EMAILID, PHONE_TYPE_CD, PHONE FROM (
    SELECT {strip('ACCT_ID')} AS ACCT_ID, {strip('PER_ID')} AS PER_ID, {strip('ENTITY_NAME')} AS ENTITY_NAME,
      lower({strip('EMAILID')}) AS EMAILID,
      CASE WHEN upper({strip('PHONE_TYPE_CD')}) IN ('CELL', 'CEL', 'MOBILE', 'MOB') THEN 'CELL'
        WHEN upper({strip('PHONE_TYPE_CD')}) IN ('HOME', 'HM') THEN 'HOME'
        WHEN upper({strip('PHONE_TYPE_CD')}) IN ('WORK', 'WK', 'BUS', 'BUSINESS') THEN 'WORK'
        ELSE upper({strip('PHONE_TYPE_CD')}) END AS PHONE_TYPE_CD,
      {strip('PHONE')} AS PHONE, ord
    FROM raw_person)
  WHERE ACCT_ID IS NOT NULL AND PER_ID IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ACCT_ID, PER_ID ORDER BY ord) = 1
),
summer_year AS (
  SELECT min(year(END_READ_DTTM)) AS y FROM usage WHERE season = 'summer'
),
sp_people AS (
  SELECT DISTINCT u.SP_ID, u.ACCT_ID, p.PER_ID, p.ENTITY_NAME, p.EMAILID, p.PHONE_TYPE_CD, p.PHONE
  FROM (SELECT DISTINCT SP_ID, ACCT_ID FROM usage) u JOIN people p ON u.ACCT_ID = p.ACCT_ID
),
sp_attributes AS (
  SELECT SP_ID,
    coalesce(string_agg(DISTINCT CHAR_PREM_ID, '|' ORDER BY CHAR_PREM_ID), '') AS CHAR_PREM_ID,
    (CASE WHEN bool_or(SA_TYPE_CD = 'WRES') THEN 'W' ELSE '' END)
      || (CASE WHEN bool_or(SA_TYPE_CD = 'WRESSEW') THEN 'S' ELSE '' END)
      || (CASE WHEN bool_or(SA_TYPE_CD = 'WRESIRR') THEN 'I' ELSE '' END)
      || (CASE WHEN bool_or(SA_TYPE_CD = 'WRECRES') THEN 'R' ELSE '' END) AS Type
  FROM usage GROUP BY SP_ID
),
bill_type_counts AS (
  SELECT SP_ID, CAST(count(DISTINCT SA_TYPE_CD) AS DOUBLE) AS bill_type_count FROM usage GROUP BY SP_ID
),
summer_raw AS (
  SELECT SP_ID, CAST(count(*) AS DOUBLE) AS summer_bill_rows,
    sum(FINAL_REG_QTY * 7.480519e-1) AS summer_total_kgal, sum(bill_days) AS summer_total_bill_days,
    avg(normalized_30day_kgal) AS summer_mean_normalized_30day_kgal,
    median(normalized_30day_kgal) AS summer_median_normalized_30day_kgal
  FROM usage WHERE season = 'summer' GROUP BY SP_ID
),
summer AS (
  SELECT s.SP_ID, s.summer_bill_rows / t.bill_type_count AS summer_bill_count,
    s.summer_total_kgal / s.summer_total_bill_days AS summer_billed_daily_avg_kgal,
    greatest(s.summer_total_kgal / s.summer_total_bill_days * 3e0, 3e-1) AS summer_triple_billed_daily_avg_kgal,
    s.summer_mean_normalized_30day_kgal, s.summer_median_normalized_30day_kgal
  FROM summer_raw s LEFT JOIN bill_type_counts t ON s.SP_ID = t.SP_ID
),
winter AS (
  SELECT w.SP_ID, w.winter_bill_rows / t.bill_type_count AS winter_bill_count,
    w.winter_mean_normalized_30day_kgal, w.winter_median_normalized_30day_kgal
  FROM (SELECT SP_ID, CAST(count(*) AS DOUBLE) AS winter_bill_rows,
          avg(normalized_30day_kgal) AS winter_mean_normalized_30day_kgal,
          median(normalized_30day_kgal) AS winter_median_normalized_30day_kgal
        FROM usage WHERE season = 'winter' GROUP BY SP_ID) w
  LEFT JOIN bill_type_counts t ON w.SP_ID = t.SP_ID
),
candidates AS (
  SELECT DISTINCT s.SP_ID FROM summer s JOIN winter w ON s.SP_ID = w.SP_ID
  WHERE s.summer_mean_normalized_30day_kgal IS NOT NULL AND w.winter_mean_normalized_30day_kgal IS NOT NULL
    AND s.summer_mean_normalized_30day_kgal > 3e0
    AND s.summer_mean_normalized_30day_kgal >= w.winter_mean_normalized_30day_kgal * 2e0
),
cand_summer AS (SELECT * FROM summer WHERE SP_ID IN (SELECT SP_ID FROM candidates)),
cand_winter AS (SELECT * FROM winter WHERE SP_ID IN (SELECT SP_ID FROM candidates)),
typed_drc AS (
  SELECT {strip('SP_ID')} AS SP_ID, strptime(BEGIN_READ_DTTM, {TS}) AS BEGIN_READ_DTTM,
    strptime(END_READ_DTTM, {TS}) AS END_READ_DTTM, CAST(CONSUMPTION AS DOUBLE) AS CONSUMPTION,
    upper({strip('UOM')}) AS UOM, coalesce(CAST(MULTIPLIER AS DOUBLE), 1e0) AS MULTIPLIER
  FROM raw_drc
),
converted_drc AS (
  SELECT *, date_sub('second', BEGIN_READ_DTTM, END_READ_DTTM) / 86400e0 AS interval_days,
    CASE WHEN UOM IN ('CCF') THEN CONSUMPTION * MULTIPLIER * 7.480519e-1
         WHEN UOM IN ('GAL') THEN CONSUMPTION * MULTIPLIER * 1e-3 END AS interval_kgal
  FROM typed_drc
),
prepared_all AS (
  SELECT * FROM converted_drc
  WHERE SP_ID IS NOT NULL AND BEGIN_READ_DTTM IS NOT NULL AND END_READ_DTTM IS NOT NULL
    AND CONSUMPTION IS NOT NULL AND END_READ_DTTM > BEGIN_READ_DTTM
    AND interval_days IS NOT NULL AND interval_kgal IS NOT NULL AND interval_days > 0
),
prepared AS (SELECT * FROM prepared_all WHERE SP_ID IN (SELECT SP_ID FROM candidates)),
win AS (
  SELECT make_timestamp(y, 4, 1, 0, 0, 0) AS ws, make_timestamp(y, 10, 1, 0, 0, 0) AS we FROM summer_year
),
clipped AS (
  SELECT *, date_sub('second', summer_begin_dttm, summer_end_dttm) / 86400e0 AS summer_overlap_days
  FROM (SELECT *, greatest(BEGIN_READ_DTTM, (SELECT ws FROM win)) AS summer_begin_dttm,
          least(END_READ_DTTM, (SELECT we FROM win)) AS summer_end_dttm FROM prepared)
),
drc_summer0 AS (
  SELECT c.*, t.summer_billed_daily_avg_kgal, t.summer_triple_billed_daily_avg_kgal,
    c.interval_kgal * c.summer_overlap_days / c.interval_days AS summer_interval_kgal,
    c.interval_days < 99e-2 AS is_subdaily_interval,
    CAST(c.summer_begin_dttm AS DATE) AS summer_begin_date,
    CAST(c.summer_end_dttm - INTERVAL 1 MICROSECOND AS DATE) AS summer_last_date
  FROM clipped c LEFT JOIN cand_summer t ON c.SP_ID = t.SP_ID
  WHERE c.summer_overlap_days > 0
),
drc_summer AS (
  SELECT *, summer_interval_kgal / summer_overlap_days AS summer_drc_daily_kgal,
    CASE WHEN summer_triple_billed_daily_avg_kgal IS NOT NULL
      THEN summer_interval_kgal / summer_overlap_days > summer_triple_billed_daily_avg_kgal
      ELSE false END AS is_above_3x
  FROM drc_summer0
),
drc_split AS (
  SELECT *, CAST(day_ts AS DATE) AS summer_date, day_ts AS day_start_dttm,
    day_ts + INTERVAL 1 DAY AS day_end_dttm
  FROM (SELECT *, unnest(generate_series(CAST(summer_begin_date AS TIMESTAMP),
          CAST(summer_last_date AS TIMESTAMP), INTERVAL 1 DAY)) AS day_ts FROM drc_summer)
),
drc_parts AS (
  SELECT *, interval_kgal * day_component_days / interval_days AS day_component_kgal
  FROM (SELECT *, date_sub('second', greatest(summer_begin_dttm, day_start_dttm),
          least(summer_end_dttm, day_end_dttm)) / 86400e0 AS day_component_days FROM drc_split)
  WHERE day_component_days > 0
),
drc_daily0 AS (
  SELECT SP_ID, summer_date, summer_billed_daily_avg_kgal, summer_triple_billed_daily_avg_kgal,
    bool_or(is_subdaily_interval) AS has_subdaily_detail,
    sum(CASE WHEN is_subdaily_interval THEN day_component_kgal ELSE 0e0 END) AS subdaily_day_kgal,
    sum(CASE WHEN NOT is_subdaily_interval THEN day_component_kgal ELSE 0e0 END) AS daily_day_kgal
  FROM drc_parts GROUP BY SP_ID, summer_date, summer_billed_daily_avg_kgal, summer_triple_billed_daily_avg_kgal
),
drc_daily AS (
  SELECT *,
    CAST(CASE WHEN summer_triple_billed_daily_avg_kgal IS NOT NULL
      THEN summer_daily_kgal > summer_triple_billed_daily_avg_kgal ELSE false END AS DOUBLE) AS above_3x_day,
    CAST(floor(date_sub('second', (SELECT ws FROM win), CAST(summer_date AS TIMESTAMP)) / 86400e0 / 7e0) AS BIGINT) + 1
      AS summer_week
  FROM (SELECT *, CASE WHEN has_subdaily_detail THEN subdaily_day_kgal ELSE daily_day_kgal END AS summer_daily_kgal
        FROM drc_daily0)
),
drc_metrics AS (
  SELECT d.SP_ID, d.summer_drc_coverage_days, d.summer_drc_above_3x_days, i.summer_drc_above_3x_intervals
  FROM (SELECT SP_ID, CAST(count(*) AS DOUBLE) AS summer_drc_coverage_days,
          sum(above_3x_day) AS summer_drc_above_3x_days FROM drc_daily GROUP BY SP_ID) d
  LEFT JOIN (SELECT SP_ID, CAST(sum(CASE WHEN is_above_3x THEN 1 ELSE 0 END) AS DOUBLE)
               AS summer_drc_above_3x_intervals FROM drc_summer GROUP BY SP_ID) i ON d.SP_ID = i.SP_ID
),
weekly_long AS (
  SELECT SP_ID, summer_week, sum(above_3x_day) AS above_3x_days FROM drc_daily GROUP BY SP_ID, summer_week
),
weekly_flags AS (
  SELECT SP_ID, {", ".join(f"coalesce(sum(CASE WHEN summer_week = {i} THEN above_3x_days END), 0e0) AS {w}" for i, w in enumerate(WEEKS, 1))}
  FROM weekly_long GROUP BY SP_ID
),
panel_base AS (
  SELECT SP_ID, summer_billed_daily_avg_kgal, summer_triple_billed_daily_avg_kgal FROM (
    SELECT SP_ID, summer_billed_daily_avg_kgal, summer_triple_billed_daily_avg_kgal, 0 AS src FROM cand_summer
    UNION ALL
    SELECT m.SP_ID, t.summer_billed_daily_avg_kgal, t.summer_triple_billed_daily_avg_kgal, 1
    FROM drc_metrics m LEFT JOIN cand_summer t ON m.SP_ID = t.SP_ID)
  QUALIFY row_number() OVER (PARTITION BY SP_ID ORDER BY src) = 1
),
summary_raw AS (
  SELECT p.SP_ID, p.ACCT_ID, p.PER_ID, p.ENTITY_NAME, p.EMAILID, p.PHONE_TYPE_CD, p.PHONE,
    a.Type, a.CHAR_PREM_ID, s.summer_bill_count, s.summer_billed_daily_avg_kgal,
    s.summer_triple_billed_daily_avg_kgal, s.summer_mean_normalized_30day_kgal,
    s.summer_median_normalized_30day_kgal,
    coalesce(m.summer_drc_coverage_days, 0e0) AS summer_drc_coverage_days,
    coalesce(m.summer_drc_above_3x_days, 0e0) AS summer_drc_above_3x_days,
    coalesce(m.summer_drc_above_3x_intervals, 0e0) AS summer_drc_above_3x_intervals,
    w.winter_bill_count, w.winter_mean_normalized_30day_kgal, w.winter_median_normalized_30day_kgal
  FROM (SELECT * FROM sp_people WHERE SP_ID IN (SELECT SP_ID FROM candidates)) p
  JOIN (SELECT * FROM sp_attributes WHERE SP_ID IN (SELECT SP_ID FROM candidates)) a ON p.SP_ID = a.SP_ID
  LEFT JOIN cand_summer s ON p.SP_ID = s.SP_ID
  LEFT JOIN drc_metrics m ON p.SP_ID = m.SP_ID
  LEFT JOIN cand_winter w ON p.SP_ID = w.SP_ID
),
summary AS (
  SELECT SP_ID, ACCT_ID, PER_ID, ENTITY_NAME, EMAILID, PHONE_TYPE_CD, PHONE, Type, CHAR_PREM_ID,
    summer_bill_count,
    {r('summer_billed_daily_avg_kgal', 4)} AS summer_billed_daily_avg_kgal,
    {r('summer_triple_billed_daily_avg_kgal', 4)} AS summer_triple_billed_daily_avg_kgal,
    {r('summer_mean_normalized_30day_kgal', 2)} AS summer_mean_normalized_30day_kgal,
    {r('summer_median_normalized_30day_kgal', 2)} AS summer_median_normalized_30day_kgal,
    {r('summer_drc_coverage_days', 2)} AS summer_drc_coverage_days,
    {r('summer_drc_above_3x_days', 2)} AS summer_drc_above_3x_days,
    {r('summer_drc_above_3x_intervals', 2)} AS summer_drc_above_3x_intervals,
    winter_bill_count,
    {r('winter_mean_normalized_30day_kgal', 2)} AS winter_mean_normalized_30day_kgal,
    {r('winter_median_normalized_30day_kgal', 2)} AS winter_median_normalized_30day_kgal
  FROM summary_raw
),
diag AS (
  SELECT
    (SELECT count(*) FROM candidates) AS candidate_sp_ids,
    (SELECT count(*) FROM raw_drc) AS raw_drc_rows,
    (SELECT count(DISTINCT {strip('SP_ID')}) FROM raw_drc) AS raw_drc_sp_ids,
    (SELECT count(*) FROM raw_drc WHERE upper({strip('UOM')}) IN ('CCF', 'GAL')) AS raw_supported_uom_rows,
    (SELECT count(DISTINCT {strip('SP_ID')}) FROM raw_drc WHERE upper({strip('UOM')}) IN ('CCF', 'GAL'))
      AS raw_supported_uom_sp_ids,
    (SELECT count(*) FROM prepared) AS prepared_drc_rows,
    (SELECT count(DISTINCT SP_ID) FROM prepared) AS prepared_drc_sp_ids,
    (SELECT count(*) FROM clipped WHERE summer_overlap_days > 0) AS summer_overlap_drc_rows,
    (SELECT count(DISTINCT SP_ID) FROM clipped WHERE summer_overlap_days > 0) AS summer_overlap_drc_sp_ids,
    (SELECT count(DISTINCT SP_ID) FROM clipped WHERE summer_overlap_days > 0
       AND SP_ID IN (SELECT SP_ID FROM cand_summer)) AS summer_overlap_with_billed_threshold_sp_ids,
    (SELECT count(DISTINCT SP_ID) FROM clipped WHERE summer_overlap_days > 0
       AND SP_ID NOT IN (SELECT SP_ID FROM cand_summer)) AS summer_overlap_without_billed_threshold_sp_ids,
    (SELECT count(DISTINCT SP_ID) FROM summary) AS summary_sp_ids,
    (SELECT count(DISTINCT SP_ID) FROM summary WHERE summer_drc_coverage_days > 0)
      AS summary_sp_ids_with_any_drc_coverage,
    (SELECT count(DISTINCT SP_ID) FROM summary WHERE summer_drc_coverage_days > 170)
      AS summary_sp_ids_with_drc_coverage_gt_170
)"""

PREFIX = "WITH " + FIXTURES + "," + STEPS + "\n"

# with no read file: the same steps over an empty read table
PREFIX_NO_READS = PREFIX.replace(
    "FROM ev_b\n),", "FROM ev_b\n  WHERE false\n),", 1)

# with the reads of every service point, not of candidates only
PREFIX_ALL_READS = PREFIX.replace(
    "prepared AS (SELECT * FROM prepared_all WHERE SP_ID IN (SELECT SP_ID FROM candidates))",
    "prepared AS (SELECT * FROM prepared_all)", 1)

ALL_WEEKS = ", ".join(WEEKS)
READ_KEY = "SP_ID, BEGIN_READ_DTTM, END_READ_DTTM"
BILL_COLS = ("BSEG_ID, SP_ID, SA_ID, ACCT_ID, SA_TYPE_CD, CHAR_PREM_ID, PREM_ID, ADDRESS1, "
             "FINAL_REG_QTY, START_READ_DTTM, END_READ_DTTM, FINAL_UOM_CD")


def _panel_sql() -> str:
    cols = [f"{r('b.summer_billed_daily_avg_kgal', 4)} AS summer_billed_daily_avg_kgal",
            f"{r('b.summer_triple_billed_daily_avg_kgal', 4)} AS summer_triple_billed_daily_avg_kgal"]
    for c in ("summer_drc_coverage_days", "summer_drc_above_3x_days", "summer_drc_above_3x_intervals"):
        cols.append(f"{r(f'coalesce(m.{c}, 0e0)', 2)} AS {c}")
    for w in WEEKS:
        cols.append(f"{r(f'coalesce(f.{w}, 0e0)', 2)} AS {w}")
    return ("SELECT b.SP_ID, " + ", ".join(cols) + " FROM panel_base b "
            "LEFT JOIN drc_metrics m ON b.SP_ID = m.SP_ID LEFT JOIN weekly_flags f ON b.SP_ID = f.SP_ID")


SUMMARY_SELECT = "SELECT " + ", ".join(SUMMARY_COLUMNS) + " FROM summary"

BODIES = {
    "clean_bills": f"SELECT {BILL_COLS}, bill_days, normalized_30day_kgal, season FROM usage",
    "dedup_keep_last": f"SELECT {BILL_COLS} FROM dedup_bills",
    "dedup_keep_first": """SELECT ACCT_ID, PER_ID, ENTITY_NAME, EMAILID, PHONE_TYPE_CD, PHONE FROM raw_person
        QUALIFY row_number() OVER (PARTITION BY ACCT_ID, PER_ID ORDER BY ord) = 1""",
    "normalised_volume": "SELECT BSEG_ID, SP_ID, bill_days, normalized_30day_kgal FROM usage",
    "season_tag": "SELECT BSEG_ID, END_READ_DTTM, CAST(month(END_READ_DTTM) AS BIGINT) AS end_month, season FROM usage",
    "timestamp_parse": """SELECT BSEG_ID, START_READ_DTTM, END_READ_DTTM, CAST(END_READ_DTTM AS DATE) AS end_date,
        CAST(CAST(END_READ_DTTM AS DATE) AS TIMESTAMP) AS end_midnight,
        CAST(END_READ_DTTM AS VARCHAR) AS end_text FROM typed_bills""",
    "service_code": "SELECT SP_ID, Type FROM sp_attributes",
    "premise_list": "SELECT SP_ID, CHAR_PREM_ID FROM sp_attributes",
    "bill_counts": """SELECT t.SP_ID, t.bill_type_count, s.summer_bill_count, w.winter_bill_count
        FROM bill_type_counts t LEFT JOIN summer s ON t.SP_ID = s.SP_ID LEFT JOIN winter w ON t.SP_ID = w.SP_ID""",
    "summer_threshold": f"""SELECT SP_ID, {r('summer_billed_daily_avg_kgal', 4)} AS summer_billed_daily_avg_kgal,
        {r('summer_triple_billed_daily_avg_kgal', 4)} AS summer_triple_billed_daily_avg_kgal FROM summer""",
    "season_stats": f"""SELECT a.SP_ID,
        {r('s.summer_mean_normalized_30day_kgal', 2)} AS summer_mean_normalized_30day_kgal,
        {r('s.summer_median_normalized_30day_kgal', 2)} AS summer_median_normalized_30day_kgal,
        {r('w.winter_mean_normalized_30day_kgal', 2)} AS winter_mean_normalized_30day_kgal,
        {r('w.winter_median_normalized_30day_kgal', 2)} AS winter_median_normalized_30day_kgal
        FROM sp_attributes a LEFT JOIN summer s ON a.SP_ID = s.SP_ID LEFT JOIN winter w ON a.SP_ID = w.SP_ID""",
    "candidate_screen": "SELECT SP_ID FROM candidates",
    "summer_year": "SELECT CAST(y AS BIGINT) AS summer_year FROM summer_year",
    "phone_types": f"""SELECT DISTINCT PHONE_TYPE_CD AS raw_phone_type_cd,
        CASE WHEN upper({strip('PHONE_TYPE_CD')}) IN ('CELL', 'CEL', 'MOBILE', 'MOB') THEN 'CELL'
          WHEN upper({strip('PHONE_TYPE_CD')}) IN ('HOME', 'HM') THEN 'HOME'
          WHEN upper({strip('PHONE_TYPE_CD')}) IN ('WORK', 'WK', 'BUS', 'BUSINESS') THEN 'WORK'
          ELSE upper({strip('PHONE_TYPE_CD')}) END AS PHONE_TYPE_CD FROM raw_person""",
    "clean_people": "SELECT * FROM people",
    "sp_contacts": "SELECT * FROM sp_people",
    "clean_intervals": """SELECT SP_ID, BEGIN_READ_DTTM, END_READ_DTTM, CONSUMPTION, UOM, MULTIPLIER,
        interval_days, interval_kgal FROM prepared_all""",
    "unit_conversion": "SELECT SP_ID, BEGIN_READ_DTTM, UOM, CONSUMPTION, MULTIPLIER, interval_kgal FROM converted_drc",
    "interval_clip": f"""SELECT {READ_KEY}, summer_begin_dttm, summer_end_dttm, summer_overlap_days
        FROM clipped WHERE summer_overlap_days > 0""",
    "interval_prorate": f"""SELECT {READ_KEY}, summer_interval_kgal, summer_drc_daily_kgal, is_subdaily_interval,
        summer_begin_date, summer_last_date FROM drc_summer""",
    "interval_above": """SELECT SP_ID, CAST(sum(CASE WHEN is_above_3x THEN 1 ELSE 0 END) AS DOUBLE)
        AS summer_drc_above_3x_intervals FROM drc_summer GROUP BY SP_ID""",
    "day_split": f"SELECT {READ_KEY}, summer_date, day_start_dttm, day_end_dttm FROM drc_split",
    "day_parts": f"SELECT {READ_KEY}, summer_date, day_component_days, day_component_kgal FROM drc_parts",
    "day_reconcile": f"""SELECT SP_ID, summer_date, has_subdaily_detail,
        {r('subdaily_day_kgal', 6)} AS subdaily_day_kgal, {r('daily_day_kgal', 6)} AS daily_day_kgal,
        {r('summer_daily_kgal', 6)} AS summer_daily_kgal FROM drc_daily""",
    "day_above": "SELECT SP_ID, summer_date, above_3x_day FROM drc_daily",
    "summer_week": "SELECT SP_ID, summer_week, above_3x_days FROM weekly_long",
    "coverage_metrics": "SELECT * FROM drc_metrics",
    "weekly_pivot": f"SELECT SP_ID, {ALL_WEEKS} FROM weekly_flags",
    "weekly_panel": _panel_sql(),
    "summary": SUMMARY_SELECT,
    "summary_with_parcel": """SELECT s.*, p.LND_SQFOOT FROM summary s LEFT JOIN (
        SELECT CIS_SP_ID, LND_SQFOOT FROM raw_parcel WHERE CIS_SP_ID IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY CIS_SP_ID ORDER BY ord DESC) = 1) p ON s.SP_ID = p.CIS_SP_ID""",
    "diagnostics": "SELECT " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in DIAGNOSTIC_COLUMNS) + " FROM diag",
    "coverage_report": " UNION ALL ".join(
        [f"SELECT '{c}' AS metric, CAST({c} AS BIGINT) AS value FROM diag" for c in DIAGNOSTIC_COLUMNS]
        + ["SELECT 'consumption_rows', CAST(count(*) AS BIGINT) FROM raw_consumption",
           "SELECT 'person_rows', CAST(count(*) AS BIGINT) FROM raw_person",
           "SELECT 'drc_rows', CAST(count(*) AS BIGINT) FROM raw_drc"]),
}


def oracle_sql() -> dict[str, str]:
    out = {name: PREFIX + body for name, body in BODIES.items()}
    out["weekly_panel_no_reads"] = PREFIX_NO_READS + _panel_sql()
    out["weekly_panel_all_reads"] = PREFIX_ALL_READS + _panel_sql()
    out["diagnostics_all_reads"] = PREFIX_ALL_READS + BODIES["diagnostics"]
    for name, same in (("day_reconcile_shuffled", "day_reconcile"), ("csv_clean_bills", "clean_bills"),
                       ("csv_clean_people", "clean_people"), ("csv_clean_intervals", "clean_intervals"),
                       ("csv_summary", "summary_with_parcel"), ("csv_panel", "weekly_panel"),
                       ("panel_absent_reads", "weekly_panel_no_reads"), ("timestamp_inferred", "clean_bills")):
        out[name] = out[same]
    key = "SP_ID, PER_ID, ACCT_ID"
    order = ", ".join(f"{c} NULLS FIRST" for c in key.split(", "))
    out["csv_summary_order"] = f"SELECT {key}, row_number() OVER (ORDER BY {order}) AS row_no FROM ({out['summary']})"
    out["csv_panel_order"] = f"SELECT SP_ID, row_number() OVER (ORDER BY SP_ID NULLS FIRST) AS row_no FROM ({out['weekly_panel']})"
    out["csv_quoted_newlines"] = f"""SELECT ACCT_ID, PER_ID, ENTITY_NAME || ' é' || CASE WHEN PER_ID LIKE '%B'
        THEN chr(160) || chr(10) || '2nd line' ELSE '' END AS ENTITY_NAME, EMAILID, PHONE_TYPE_CD, PHONE
        FROM ({out["clean_people"]})"""
    return out
