import pytest
from rows import bill
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hydrosight.operators import bills as B
from hydrosight.params import Params

C = 0.7480519


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_keep_last_runs_before_length_filter(make):
    # The last copy of X is 45 days long, so X disappears entirely
    raw = make.bills([
        bill("X", "SP1", "A1", "WRES", 10, "2024-06-01 00:00:00", "2024-07-01 00:00:00", ord_=1),
        bill("X", "SP1", "A1", "WRES", 10, "2024-05-17 00:00:00", "2024-07-01 00:00:00", ord_=2),
        bill("Y", "SP1", "A1", "WRES", 10, "2024-05-17 00:00:00", "2024-07-01 00:00:00", ord_=1),
        bill("Y", "SP1", "A1", "WRES", 10, "2024-06-01 00:00:00", "2024-07-01 00:00:00", ord_=2),
    ])
    assert rows(B.clean_bills(raw), "BSEG_ID") == [("Y",)]


def test_nulls_dropped_before_dedup(make):
    # a later copy with a null quantity is dropped first, so the earlier copy wins
    raw = make.bills([
        bill("X", "SP1", "A1", "WRES", 7, "2024-06-01 00:00:00", "2024-07-01 00:00:00", ord_=1),
        bill("X", "SP1", "A1", "WRES", None, "2024-06-01 00:00:00", "2024-07-01 00:00:00", ord_=2),
    ])
    assert rows(B.clean_bills(raw), "FINAL_REG_QTY") == [(7.0,)]


def test_length_edges_and_types(make):
    raw = make.bills([
        bill("a", "SP1", "A1", " wres ", 1, "2024-06-10 00:00:00", "2024-06-30 00:00:00"),  # 20.0 kept
        bill("b", "SP1", "A1", "WRESSEW", 1, "2024-05-21 00:00:00", "2024-06-30 00:00:00"),  # 40.0 kept
        bill("c", "SP1", "A1", "WRES", 1, "2024-06-10 00:00:01", "2024-06-30 00:00:00"),  # < 20 dropped
        bill("d", "SP1", "A1", "WRES", 1, "2024-05-20 23:59:59", "2024-06-30 00:00:00"),  # > 40 dropped
        bill("e", "SP1", "A1", "ERES", 1, "2024-06-10 00:00:00", "2024-06-30 00:00:00"),  # type dropped
    ])
    assert rows(B.clean_bills(raw), "BSEG_ID", "SA_TYPE_CD", "bill_days") == [
        ("a", "WRES", 20.0), ("b", "WRESSEW", 40.0)]


def test_blank_ids_are_kept_as_empty(make):
    raw = make.bills([bill("z", " \t", "A1", "WRES", 1, "2024-06-01 00:00:00", "2024-07-01 00:00:00")])
    assert rows(B.clean_bills(raw), "SP_ID") == [("",)]   # T8


def test_volume_and_season(make):
    raw = make.bills([
        bill("s", "SP1", "A1", "WRES", 10, "2024-08-02 00:00:00", "2024-09-01 00:00:00"),
        bill("w", "SP1", "A1", "WRES", 10, "2024-09-05 00:00:00", "2024-10-01 00:00:00"),
    ])
    got = dict(rows(B.clean_bills(raw), "BSEG_ID", "season"))
    assert got == {"s": "summer", "w": "winter"}
    vol = dict(rows(B.clean_bills(raw), "BSEG_ID", "normalized_30day_kgal"))
    assert vol["s"] == 10 * C * 30.0 / 30.0
    assert vol["w"] == 10 * C * 30.0 / 26.0


def _season_rows(sp, acct, summer_qtys, winter_qtys, types=("WRES",), prem=None):
    out, n = [], 0
    for q in summer_qtys:
        for t in types:
            n += 1
            out.append(bill(f"{sp}-s{n}", sp, acct, t, q, "2024-06-01 00:00:00", "2024-07-01 00:00:00", prem=prem))
    for q in winter_qtys:
        for t in types:
            n += 1
            out.append(bill(f"{sp}-w{n}", sp, acct, t, q, "2024-12-01 00:00:00", "2024-12-31 00:00:00", prem=prem))
    return out


def test_season_stats_and_screen(make):
    raw = make.bills(
        _season_rows("SP1", "A1", [10, 20], [2])                      # mean 11.2 kgal: candidate
        + _season_rows("SP2", "A2", [10], [5])                         # exactly 2x: candidate
        + _season_rows("SP3", "A3", [10], [5.01])                      # just under 2x: not
        + _season_rows("SP4", "A4", [10], [])                          # no winter: not
        + _season_rows("SP5", "A5", [6, 8, 10], [1], types=("WRES", "WRESIRR"), prem="P9")
    )
    stats = B.season_stats(B.clean_bills(raw))
    got = {r["SP_ID"]: r for r in stats.collect()}
    assert got["SP1"]["summer_mean_normalized_30day_kgal"] == pytest.approx(15 * C)
    assert got["SP1"]["summer_median_normalized_30day_kgal"] == pytest.approx(15 * C)  # midpoint
    assert got["SP5"]["summer_median_normalized_30day_kgal"] == pytest.approx(8 * C)
    assert got["SP5"]["Type"] == "WI" and got["SP5"]["CHAR_PREM_ID"] == "P9"
    assert got["SP5"]["bill_type_count"] == 2.0
    assert got["SP5"]["summer_bill_count"] == 3.0 and got["SP5"]["winter_bill_count"] == 1.0
    assert got["SP4"]["winter_bill_count"] is None
    assert got["SP1"]["CHAR_PREM_ID"] == ""
    daily = (10 + 20) * C / 60.0
    assert got["SP1"]["summer_billed_daily_avg_kgal"] == pytest.approx(daily)
    assert got["SP1"]["summer_triple_billed_daily_avg_kgal"] == pytest.approx(max(3 * daily, 0.3))
    cands = sorted(r[0] for r in B.screen(stats).select("SP_ID").collect())
    assert cands == ["SP1", "SP2", "SP5"]


def test_screen_mean_floor_is_strict(make):
    raw = make.bills(_season_rows("SP1", "A1", [10], [1]))
    floor = 10 * C * 30.0 / 30.0
    assert B.screen(B.season_stats(B.clean_bills(raw)), Params(min_summer_mean_kgal=floor)).count() == 0
    assert B.screen(B.season_stats(B.clean_bills(raw)), Params(min_summer_mean_kgal=floor - 1e-9)).count() == 1


def test_threshold_floor(make):
    raw = make.bills(_season_rows("SP1", "A1", [0.1], [0.01]))
    r = B.season_stats(B.clean_bills(raw)).first()
    assert r["summer_triple_billed_daily_avg_kgal"] == 0.3


def test_earliest_summer_year_sets_window(make):
    # Two summers; the earliest year is the window, both pool into stats
    raw = make.bills([
        bill("a", "SP1", "A1", "WRES", 10, "2025-06-01 00:00:00", "2025-07-01 00:00:00"),
        bill("b", "SP1", "A1", "WRES", 20, "2024-06-01 00:00:00", "2024-07-01 00:00:00"),
    ])
    usage = B.clean_bills(raw)
    assert B.summer_year(usage).first()[0] == 2024
    stats = B.season_stats(usage).first()
    assert stats["summer_mean_normalized_30day_kgal"] == pytest.approx(15 * C)


def test_no_summer_year(make):
    raw = make.bills([bill("a", "SP1", "A1", "WRES", 10, "2024-12-01 00:00:00", "2024-12-31 00:00:00")])
    assert B.summer_year(B.clean_bills(raw)).first()[0] is None


def test_nan_quantity_is_not_dropped(make):
    raw = make.bills([bill("a", "SP1", "A1", "WRES", "NaN", "2024-06-01 00:00:00", "2024-07-01 00:00:00")])
    assert B.clean_bills(raw).where(F.isnan("FINAL_REG_QTY")).count() == 1   # T3


def test_bad_text_fails_on_rows_that_a_null_key_drops(make):
    good = ("SP1", "A1", "WRES", 1, "2024-06-01 00:00:00", "2024-07-01 00:00:00")
    assert B.clean_bills(make.bills([bill(None, *good), bill("x", *good)])).count() == 1
    for row in (bill(None, "SP1", "A1", "WRES", 1, "2024-06-01 00:00:00", "not a time"),
                bill("x", None, "A1", "WRES", "1d", "2024-06-01 00:00:00", "2024-07-01 00:00:00")):
        with pytest.raises(PySparkException, match="unparseable"):
            B.clean_bills(make.bills([row])).count()


def test_formats_per_column(make):
    raw = make.bills([bill("x", "SP1", "A1", "WRES", 1, "06/01/2024 00:00", "2024-07-01 00:00")])
    p = Params(ts_formats=(("START_READ_DTTM", "MM/dd/yyyy HH:mm"),))
    assert rows(B.clean_bills(raw, p), "bill_days") == [(30.0,)]


def test_formats_are_inferred_and_parsed_once(make):
    raw = make.bills([bill("x", "SP1", "A1", "WRES", 1, "06/01/2024 00:00", "2024-07-01 00:00"),
                      bill("y", "SP1", "A1", "WRES", 1, "06/21/2024 00:00", "2024-07-21 00:00")])
    usage = B.clean_bills(raw, Params(ts_format="infer"))
    assert rows(usage, "bill_days") == [(30.0,), (30.0,)]
    wide = usage.join(usage.select("SP_ID").distinct().withColumnRenamed("SP_ID", "k"), F.col("SP_ID") == F.col("k"))
    plan = B.clean_bills(raw).join(wide.select("k"), F.col("SP_ID") == F.col("k"))._jdf.queryExecution().optimizedPlan().toString()
    own = plan.split("Generate inline")[1].split("\n")[0]
    assert own.count("RLIKE") == 3 and "RLIKE" not in plan.split("Generate inline")[0]  # none in the join or the filters


def test_premise_list_is_distinct_and_sorted(make):
    raw = make.bills([bill(f"b{i}", "SP1", "A1", "WRES", 1, "2024-06-01 00:00:00", "2024-07-01 00:00:00", prem=p)
                      for i, p in enumerate(["P2", "P10", None, "P2", " P1 "])])
    assert rows(B.premise_lists(B.clean_bills(raw)), "SP_ID", "CHAR_PREM_ID") == [("SP1", "P1|P10|P2")]


def test_ids_are_padded_never_cut(spark):
    from hydrosight.sources.testdata import _pad7
    import duckdb
    ids = [1, 1234567, 12345678, 123456789012]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i bigint").select(_pad7(F.col("i"))).collect()]
    assert got == ["0000001", "1234567", "12345678", "123456789012"]
    assert [duckdb.sql(f"SELECT printf('%07d', {i}::BIGINT)").fetchall()[0][0] for i in ids] == got


def test_copies_that_the_filters_drop_travel_without_their_fields(make):
    raw = make.bills([bill("a", "SP1", "A1", "ERES", 1, "2024-06-01 00:00:00", "2024-07-01 00:00:00")])
    df = B.clean_bills(raw)
    assert "max_by(CASE WHEN" in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 0
