import pytest
from pyspark.sql import functions as F

from hydrosight.operators.joins import heavy_keys, join_checked
from hydrosight.params import Params

SPLIT = Params(broadcast_max_bytes=-1)


@pytest.fixture
def big(spark):
    """A third of the rows has one key, a third none, the others a key each."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string"))
    return spark.range(30_000).select(key.alias("k"), F.col("id").alias("at"))


@pytest.fixture
def small(spark):
    return spark.createDataFrame([("hot", 1), ("2", 2), ("5", 3), ("absent", 4), (None, 5)], "k string, v int")


def test_heavy_keys_are_those_above_a_task_s_share(big):
    assert heavy_keys(big, "k") == {"hot": 3, None: 3}  # a third of 8 tasks' rows
    assert heavy_keys(big.where("at % 3 = 2"), "k") == {}
    assert heavy_keys(big.where("false"), "k") == {}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_split_join_gives_the_same_rows(big, small, how):
    same = [sorted(map(str, join_checked(big, small, "k", how, 1, "at", p).select("at", *(["v"] if how != "left_semi" else []))
                       .collect())) for p in (Params(), SPLIT)]
    assert same[0] == same[1] and len(same[0]) == (30_000 if how == "left" else 10_002)


def test_only_heavy_keys_are_repeated(spark, big, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)  # it would join small partitions again
    try:
        joined = join_checked(big, small, "k", "inner", 1, "at", SPLIT)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k" in plan and "_part" in plan
        hot = joined.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
        light = join_checked(big.where("at % 3 = 2"), small, "k", "inner", 1, "at", SPLIT)
        assert "_part#" not in light._jdf.queryExecution().executedPlan().toString() and light.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert hot >= 2


def test_a_column_s_keys_may_come_from_elsewhere(big, small):
    got = join_checked(big, small, "k", "left", 1, "at", SPLIT, keys=big.select("k"))
    assert got.count() == 30_000 and got.where("v = 1").count() == 10_000
