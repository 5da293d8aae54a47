"""Keep-first / keep-last per key (A17, A18) and union-then-keep-first.

Implemented as one aggregate per key with ``min_by``/``max_by`` over a
struct of the row: Spark plans a partial aggregate before the exchange, so
a key that holds a third of all rows leaves each map task as one row.
A condition on the picked row travels with it: a row that doesn't meet it is a null in the exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrosight.sources.schemas import ORD


def _pick(df: DataFrame, keys: list[str], order: str, fn, where: Column | None = None) -> DataFrame:
    payload = [c for c in df.columns if c not in keys and c != order]
    if not payload and where is None:
        return df.select(*keys).distinct()
    row = F.struct(*(payload or [F.lit(True).alias("_only_keys")]))
    if where is not None:
        row = F.when(where, row)
    picked = df.groupBy(*keys).agg(fn(row, F.col(order)).alias("_row"))
    if where is not None:
        picked = picked.where(F.col("_row").isNotNull())
    out = picked.select(*keys, "_row.*")
    return out.select(*[c for c in df.columns if c != order])


def keep_last(df: DataFrame, keys: list[str], order: str = ORD, where: Column | None = None) -> DataFrame:
    """The row with the greatest ``order`` per key; its null fields survive. ``where`` filters
    the picked rows, not their rivals: a key whose last row doesn't meet it goes."""
    return _pick(df, keys, order, F.max_by, where)


def keep_first(df: DataFrame, keys: list[str], order: str = ORD) -> DataFrame:
    """The row with the smallest ``order`` per key."""
    return _pick(df, keys, order, F.min_by)


def union_keep_first(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union by name (types widened), then per key the row of the earliest
    frame wins (U1, U2, A19)."""
    ranked = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)]
    unioned = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return keep_first(unioned, keys, order="_src")
