"""Exact medians of groups of any size, without a group in one task.

1. distinct (group, value) with counts: ties collapse before the exchange, and
   a hot group spreads over tasks by value; steps 2 and 4 read this one exchange;
2. counts by (group, range): a range is a 32nd of a power of two, an
   order-preserving function of the value that needs no look at the data;
3. a group's ranges (a few, whatever its rows) as one sorted array: one walk
   over it gives the ranges that hold the two middle ranks;
4. a running sum over the distinct values of those ranges finds the values.

Counts are exact, so the median is: 0.5 * low + 0.5 * high, or the one middle value.
NaN counts as the largest value, -0.0 as 0.0.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_range(v: Column) -> Column:
    """An integer that never falls as the value rises; NaN is largest, as in sorting."""
    steps = F.floor(F.log2(F.abs(v)) * 32).cast("bigint") + 40_000
    inf = F.signum(v).cast("bigint") * (1 << 39)
    at = (F.when(F.isnan(v), F.lit(1 << 40)).when(F.abs(v) == float("inf"), inf)
          .when(v > 0, steps).when(v < 0, -steps))
    return F.coalesce(at, F.lit(0).cast("bigint"))  # never null: joins by it add no filter


def _middle(ranges: str) -> Column:
    """Of a sorted array of (_b, _bc): the rows (_b, _lo, _hi) of the one or two ranges with a middle
    rank, which are 0-based and count from the range's start; null where the rank lies in the other."""
    at = "struct(CAST(NULL AS BIGINT) AS _b, CAST(NULL AS BIGINT) AS _at)"
    hit = ("CASE WHEN {t} >= a._before AND {t} < a._before + x._bc "
           "THEN struct(x._b AS _b, {t} - a._before AS _at) ELSE a.{side} END AS {side}")
    found = (f"aggregate({ranges}, struct(0L AS _before, {at} AS _lo, {at} AS _hi), (a, x) -> struct("
             "a._before + x._bc AS _before, " + hit.format(t="((_n - 1) div 2)", side="_lo") + ", "
             + hit.format(t="(_n div 2)", side="_hi") + "))")
    return F.expr(found)


def exact_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., median) for every group of ``rows`` with no null key (null values ignored)."""
    v = F.col(value)
    # both readers of ``d`` have the same filters (no key or range is null), so they share its exchange
    filled = reduce(and_, (F.col(c).isNotNull() for c in [*keys, value]))
    d = rows.where(filled).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", value_range(v))
    ranges = d.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    middle = (ranges.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", "_bc"))).alias("_r"),
                                        F.sum("_bc").alias("_n"))
              .select(*keys, _middle("_r").alias("_m")))
    one = "array(struct(_m._lo._b AS _b, _m._lo._at AS _lo, _m._hi._at AS _hi))"
    two = ("array(struct(_m._lo._b AS _b, _m._lo._at AS _lo, CAST(NULL AS BIGINT) AS _hi), "
           "struct(_m._hi._b AS _b, CAST(NULL AS BIGINT) AS _lo, _m._hi._at AS _hi))")
    targets = middle.select(*keys, F.expr(f"inline(IF(_m._lo._b = _m._hi._b, {one}, {two}))"))
    run = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    hit = d.join(targets, [*keys, "_b"]).select("*", F.sum("_c").over(run).alias("_run"))
    pair = hit.groupBy(*keys).agg(*[F.max(F.when(F.expr(f"{side} < _run AND {side} >= _run - _c"), v)).alias(f"{side}_value")
                                    for side in ("_lo", "_hi")])
    lo, hi = F.col("_lo_value"), F.col("_hi_value")
    return pair.select(*keys, F.when(lo == hi, lo).otherwise(F.lit(0.5) * lo + F.lit(0.5) * hi).alias("median"))
