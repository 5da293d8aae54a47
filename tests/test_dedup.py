from pyspark.sql import functions as F

from hydrosight.operators.dedup import keep_first, keep_last, union_keep_first


def test_keep_last_takes_whole_row_nulls_included(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "y", 5), ("b", "z", 3)],
                               "k string, v string, _ord int")
    got = sorted(tuple(r) for r in keep_last(df, ["k"]).collect())
    assert got == [("a", None), ("b", "y")]


def test_keep_first(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "w", 0), ("b", "y", 5)], "k string, v string, _ord int")
    assert sorted(tuple(r) for r in keep_first(df, ["k"]).collect()) == [("a", "w"), ("b", "y")]


def test_union_keep_first_left_wins_and_widens(spark):
    a = spark.createDataFrame([("s1", 1)], "k string, v int")
    b = spark.createDataFrame([("s1", 9), ("s2", 2)], "k string, v bigint")
    out = union_keep_first([a, b], ["k"])
    assert dict(out.dtypes)["v"] == "bigint"
    assert sorted(tuple(r) for r in out.collect()) == [("s1", 1), ("s2", 2)]


def test_dedup_unchanged_by_partitioning(spark):
    rows = [(f"k{i % 37}", f"v{i}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v string, _ord int")
    a = sorted(tuple(r) for r in keep_last(df, ["k"]).collect())
    b = sorted(tuple(r) for r in keep_last(df.repartition(7), ["k"]).collect())
    assert a == b and len(a) == 37


def test_condition_filters_picked_rows_not_their_rivals(spark):
    rows = [("a", "x", 1), ("a", "bad", 2), ("b", "bad", 1), ("b", "y", 2), ("c", None, 1), ("c", None, 2),
            ("d", "z", 1), ("d", None, 2), (None, "n", 1)]
    df = spark.createDataFrame(rows, "k string, v string, _ord int").repartition(3)
    ok = F.col("v") != "bad"  # null on a null: such a row goes too, as in where()
    got = keep_last(df, ["k"], where=ok)
    assert sorted((tuple(r) for r in got.collect()), key=str) == [("b", "y"), (None, "n")]
    assert got.columns == ["k", "v"]
    plain = keep_last(df, ["k"]).where(ok)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    keys = keep_last(df.select("k", "_ord"), ["k"], where=F.col("_ord") == 2)
    assert sorted(r.k for r in keys.collect()) == ["a", "b", "c", "d"]
