import datetime as dt

import pytest
from rows import read
from pyspark.sql import functions as F

from hydrosight.operators import intervals as I
from hydrosight.operators import read_pass as R
from hydrosight.params import Params

C = 0.7480519
START, END = dt.date(2024, 4, 1), dt.date(2024, 10, 1)


def steps(spark, make, rows, triple=1.0):
    thr = spark.createDataFrame([("SP1", triple / 3, triple)],
                                "SP_ID string, summer_billed_daily_avg_kgal double, "
                                "summer_triple_billed_daily_avg_kgal double")
    return R.read_rows(make.reads(rows), thr, 0, START.year)


def parts_of(reads):
    return R.read_days(reads).where("positive")


def days_of(reads):
    return R.day_rows(R.read_days(reads), START.year).where("day_ok")


def test_clean_and_convert(make):
    got = I.clean_intervals(make.reads([
        read(" SP1 ", "2024-06-01 00:00:00", "2024-06-02 00:00:00", 2.0, uom=" gal ", mult=None),
        read("SP1", "2024-06-01 00:00:00", "2024-06-02 00:00:00", 2.0, uom="ccf", mult=3.0),
        read("SP1", "2024-06-01 00:00:00", "2024-06-02 00:00:00", 2.0, uom="KWH"),
        read("SP1", "2024-06-02 00:00:00", "2024-06-01 00:00:00", 2.0),
        read("SP1", "2024-06-01 00:00:00", "2024-06-01 00:00:00.5", 2.0),   # 0 whole seconds
        read("SP1", "2024-06-01 00:00:00", "2024-06-02 00:00:00", None),
    ])).select("SP_ID", "interval_kgal").collect()
    assert sorted((r[0], r[1]) for r in got) == sorted([("SP1", 2.0 * 1.0 * 0.001), ("SP1", 2.0 * 3.0 * C)])


def test_split_over_days_conserves_volume(spark, make):
    flagged = steps(spark, make, [
        read("SP1", "2024-06-01 22:00:00", "2024-06-03 02:00:00", 10.0),
        read("SP1", "2024-06-05 00:00:00", "2024-06-06 00:00:00", 1.0),    # ends at midnight
        read("SP1", "2024-03-01 00:00:00", "2024-11-01 00:00:00", 100.0),  # whole window
    ])
    parts = parts_of(flagged)
    per_read = parts.groupBy("BEGIN_READ_DTTM").agg(F.sum("day_component_kgal").alias("k"),
                                                   F.count(F.lit(1)).alias("n"))
    want = {r["BEGIN_READ_DTTM"]: r["summer_interval_kgal"] for r in flagged.collect()}
    got = {r["BEGIN_READ_DTTM"]: (r["k"], r["n"]) for r in per_read.collect()}
    for k, v in want.items():
        assert got[k][0] == pytest.approx(v, rel=1e-12)
    days = sorted(n for _, n in got.values())
    assert days == [1, 3, 183]   # midnight end adds no day; the window has 183 days


def test_sub_second_parts_are_dropped(spark, make):
    flagged = steps(spark, make, [read("SP1", "2024-07-01 23:59:59.5", "2024-07-02 00:00:01", 1.0)])
    parts = parts_of(flagged).select("summer_date").collect()
    assert [r[0] for r in parts] == [dt.date(2024, 7, 2)]   # T4


def test_reconcile_prefers_subdaily_and_counts_duplicates(spark, make):
    flagged = steps(spark, make, [
        read("SP1", "2024-06-01 22:00:00", "2024-06-02 02:00:00", 4.0),
        read("SP1", "2024-06-02 00:00:00", "2024-06-03 00:00:00", 1.0),
        read("SP1", "2024-06-05 00:00:00", "2024-06-06 00:00:00", 1.0),
        read("SP1", "2024-06-05 00:00:00", "2024-06-06 00:00:00", 1.0),
    ], triple=1.2)
    days = days_of(flagged)
    got = {r["summer_date"]: r for r in days.collect()}
    assert got[dt.date(2024, 6, 2)]["summer_daily_kgal"] == pytest.approx(2 * C)
    assert got[dt.date(2024, 6, 2)]["has_subdaily_detail"]
    assert got[dt.date(2024, 6, 5)]["summer_daily_kgal"] == pytest.approx(2 * C)   # T13
    assert got[dt.date(2024, 6, 5)]["above_3x_day"] == 1.0
    assert [r["is_above_3x"] for r in flagged.orderBy("BEGIN_READ_DTTM").collect()] == [True, False, False, False]


def test_sep_30_is_week_27(spark, make):
    flagged = steps(spark, make, [read("SP1", "2024-09-29 00:00:00", "2024-10-01 00:00:00", 9.0)])
    days = days_of(flagged)
    assert sorted((r["summer_date"].day, r["summer_week"]) for r in days.collect()) == [(29, 26), (30, 27)]


def test_hot_meter_is_split(spark, make):
    """A meter with half the reads: the join spreads it, and the day aggregate has its own exchange."""
    rows = [read("SP1", f"2024-06-{d:02d} {h:02d}:00:00", f"2024-06-{d:02d} {h + 1:02d}:00:00", 1.0)
            for d in range(1, 25) for h in range(0, 23)]
    rows += [read(f"X{i}", "2024-06-01 00:00:00", "2024-06-01 01:00:00", 1.0) for i in range(len(rows))]
    thr = spark.createDataFrame([("SP1", 1.0, 3.0), ("X1", 1.0, 3.0)],
                                "SP_ID string, summer_billed_daily_avg_kgal double, "
                                "summer_triple_billed_daily_avg_kgal double")
    raw, split = make.reads(rows), Params(broadcast_max_bytes=-1)
    tables = [R.per_service_point(R.day_rows(R.read_days(R.read_rows(raw, thr, 1, 2024, p)), 2024)) for p in (Params(), split)]
    a, b = (sorted(map(str, t.collect())) for t in tables)
    assert a == b
    plan = tables[1]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(SP_ID" in plan and "_part" in plan and "summer_date" in plan
    assert any("hashpartitioning(SP_ID" in x and "summer_date" in x for x in plan.splitlines())
    joined = R.read_rows(raw, thr, 1, 2024, split)
    parts = joined.where("SP_ID = 'SP1'").select(F.pmod(F.xxhash64("BEGIN_READ_DTTM"), F.lit(16))).distinct().count()
    assert parts > 8
