import math
import random

from pyspark.sql import functions as F

from hydrosight.operators.median import exact_median, value_range


def test_exact_median_matches_builtin_with_ties_and_even_counts(spark):
    rnd = random.Random(7)
    rows = []
    for g in range(12):
        n = rnd.randint(1, 400)
        pool = [rnd.uniform(-100, 100) * 10 ** rnd.randint(-3, 3) for _ in range(rnd.choice([1, 3, 50, 1000]))]
        rows += [(f"g{g}", "s", rnd.choice(pool)) for _ in range(n)]
    rows += [("g99", "s", 5.0)] * 10000          # one value repeated: one range, one distinct value
    rows += [("g98", "s", None), ("g98", "s", 2.0), ("g98", "s", 4.0)]
    rows += [("g97", "s", x) for x in (0.0, -1.0, 1e-300, float("inf"), -2.0)]
    rows += [("g96", "s", x) for x in (math.nan, 1.0, math.nan)] + [("g95", "s", x) for x in (-0.0, 0.0, -0.0)]
    rows += [("g94", "s", x) for x in (-math.inf, 3.0)] + [(None, "s", x) for x in (1.0, 1000.0)]
    df = spark.createDataFrame(rows, "k string, season string, v double")
    want = {r[0]: r[1] for r in df.groupBy("k").agg(F.median("v")).collect()}
    got = {r[0]: r[2] for r in exact_median(df, ["k", "season"], "v").collect()}
    assert math.isnan(want.pop("g96")) and math.isnan(got.pop("g96"))
    del want[None]
    assert got == want


def test_the_values_are_exchanged_once_and_nothing_is_written(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") % 31).cast("double").alias("v"))
    got = exact_median(df, ["k"], "v")
    assert len(got.collect()) == 7
    assert not got.inputFiles()
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


def test_no_group_meets_in_one_task_before_its_ranges(spark):
    """The exchange of the values is keyed by the value too, the next one by the range."""
    df = spark.range(100).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("v"))
    assert exact_median(df, ["k"], "v").first()["median"] == 49.5


def test_value_range_never_falls(spark):
    rnd = random.Random(1)
    vals = sorted(rnd.uniform(-1, 1) * 10 ** rnd.randint(-320, 300) for _ in range(3000))
    vals = [-math.inf, *vals, math.inf]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v double").select(value_range(F.col("v"))).collect()]
    assert got == sorted(got)
