import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hydrosight.functions.formats import infer_ts_forms
from hydrosight.functions import parse_double, parse_ts, round_half_even, strip_ws, whole_seconds


def one(spark, col, rows, schema="s string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_strip_removes_unicode_whitespace_and_keeps_blank_non_null(spark):
    got = one(spark, strip_ws("s"), [(" \tx y \u0085",), ("　",), (None,), ("  ",)])
    assert got == ["x y", "", None, ""]   # T5, T8: blank -> '' (not null)


def test_whole_seconds_truncate_toward_zero(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-02 00:00:00.9"),
                                ("2024-01-01 00:00:00.5", "2024-01-01 00:00:00.1")], "a string, b string")
    got = [r[0] for r in df.select(whole_seconds(parse_ts("b"), parse_ts("a"))).collect()]
    assert got == [86400, 0]   # T4


def test_naive_time_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2025-03-09 00:00:00", "2025-03-10 00:00:00")], "a string, b string")
        assert df.select(whole_seconds(parse_ts("b"), parse_ts("a"))).first()[0] == 86400
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_round_half_even(spark):
    got = one(spark, round_half_even(F.col("x"), 2), [(0.125,), (0.375,), (1.005,), (-0.125,)], "x double")
    assert got == [0.12, 0.38, 1.0, -0.12]   # T7 (1.005 is below the tie in binary)


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", "true")


@pytest.mark.parametrize("text", [
    "2024-13-45 00:00:00", "not a time", "2025-03", "2025-03-01", "2025-03-01 00:00:00+05:00", "2025-03-01T00:00:00Z",
    "2025-03-01 00:00:00 UTC", " 2025-03-01 00:00:00", "2025-03-01 00:00:00 ", "2025-03-01 24:00:00", "2025-3-1 00:00", ""])
def test_parse_ts_is_strict(spark, ansi, text):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(text,)], "s string").select(parse_ts("s")).collect()


@pytest.mark.parametrize("text", ["1d", "1.5f", " 2 ", "2 ", "0x10", "1,5", "abc", "", "1e", "--1"])
def test_parse_double_is_strict(spark, ansi, text):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(text,)], "s string").select(parse_double("s")).collect()


def test_accepted_text(spark, ansi):
    got = one(spark, parse_double("s"), [("1",), ("-1.5e3",), (".5",), ("2.",), ("inf",), (None,)])
    assert got == [1.0, -1500.0, 0.5, 2.0, float("inf"), None]
    got = one(spark, parse_ts("s").cast("string"), [("2025-03-01 00:00",), ("2025-03-01T01:02:03.5",)])
    assert got == ["2025-03-01 00:00:00", "2025-03-01 01:02:03.5"]
    bad = spark.createDataFrame([("03/41/2025",)], "s string").select(parse_ts("s", "MM/dd/yyyy"))
    with pytest.raises(PySparkException):
        bad.collect()


def test_parse_ts_accepts_fractions_and_null(spark):
    got = one(spark, parse_ts("s").cast("string"), [("2024-01-01 00:00:00.25",), (None,)])
    assert got == ["2024-01-01 00:00:00.25", None]


def test_parse_double_strict_and_nan_kept(spark):
    assert one(spark, F.isnan(parse_double("s")), [("NaN",)]) == [True]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("abc",)], "s string").select(parse_double("s")).collect()


def test_timestamp_forms_are_inferred(spark):
    rows = [("2024-06-30 01:02", "2024/06/30 01:02:03", "06/30/2024 01:02:03.5", "30/06/2024 01:02", "06-13-2024 00:00", "13-06-2024T00:00", None),
            ("2024-01-02T00:00:00", "2024/01/02 00:00", "01/02/2024 00:00", "02/01/2024 00:00", "01-02-2024 00:00", "02-01-2024 00:00", None),
            (None,) * 7]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(7)))
    forms = infer_ts_forms(df, df.columns)
    assert list(forms.values()) == ["Y-M-D", "Y/M/D", "M/D/Y", "D/M/Y", "M-D-Y", "D-M-Y", "Y-M-D"]
    got = df.select(*(parse_ts(c, f).cast("string").alias(c) for c, f in forms.items())).collect()
    assert got[0][:4] == ("2024-06-30 01:02:00", "2024-06-30 01:02:03", "2024-06-30 01:02:03.5", "2024-06-30 01:02:00")
    assert got[0][4:] == ("2024-06-13 00:00:00", "2024-06-13 00:00:00", None)
    assert set(got[1][:6]) == {"2024-01-02 00:00:00"} and set(got[2]) == {None}


@pytest.mark.parametrize("texts", [
    ["01/02/2024 00:00"],                                # month and day cannot be told apart
    ["2024-06-30 01:02", "06/30/2024 01:02"],            # two forms in one column
    ["06/31/2024 00:00"], ["30/13/2024 00:00"], ["2024-06-30"], ["2024-06-30 01:02+00:00"], [""]])
def test_unclear_timestamp_forms_fail(spark, texts):
    with pytest.raises(ValueError):
        infer_ts_forms(spark.createDataFrame([(t,) for t in texts], "s string"), ["s"])


def test_forms_are_strict(spark, ansi):
    with pytest.raises(PySparkException):
        spark.createDataFrame([("31/12/2024 00:00",)], "s string").select(parse_ts("s", "M/D/Y")).collect()
