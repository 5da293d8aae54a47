"""Joins of a large table with one row a key of a smaller one.

The small side is broadcast only when its counted bytes stay below
``Params.broadcast_max_bytes``. Beyond that both sides are shuffled by the key, and
a key that holds more rows of the large table than a task's share of them is split: its rows
are dealt to parts by a hash of ``spread``, and only the small side's row of that key is
repeated, once a part. Which keys those are is read from a frequent-items summary of the key column
(mergeable, of a fixed size). Its estimates choose the parts and nothing else, so they never change a result.
Later aggregates by the key have an exchange of their own, after a partial aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrosight.params import DEFAULT, Params

ROW_BYTES = 64  # of the fixed part of a row


def table_bytes(df: DataFrame) -> int:
    """Rows and text bytes, counted: what a broadcast of ``df`` holds."""
    texts = [c for c, t in df.dtypes if t == "string"]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0).cast("bigint"))
    fixed = ROW_BYTES + 8 * (len(df.columns) - len(texts))
    return df.agg(F.coalesce(F.sum(size + fixed), F.lit(0)).alias("n")).first()["n"]


def heavy_keys(keys: DataFrame, key: str) -> dict:
    """{key: parts} of the keys (null too) that hold more than one task's share of the rows of ``keys``.

    The share is the rows by ``spark.sql.shuffle.partitions``, so there are at most as many such keys as
    partitions, and that is all that reaches the driver."""
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(tasks, 100_000)
    seen = keys.agg(F.count(F.lit(1)).alias("n"),
                    F.expr(f"approx_top_k({key}, {most}, {max(10 * most, 10_000)})").alias("top")).first()
    share = max(seen["n"] / tasks, 1)
    return {r["item"]: min(math.ceil(r["count"] / share), tasks) for r in seen["top"] if r["count"] > share}


def join_checked(big: DataFrame, small: DataFrame, key: str, how: str, small_bytes: int,
                 spread: str, p: Params = DEFAULT, keys: DataFrame | None = None) -> DataFrame:
    """inner, left or left_semi join on ``key``; ``spread`` is a column of ``big``, ``keys`` a cheaper
    source of the key column of ``big``."""
    if small_bytes <= p.broadcast_max_bytes:
        return big.join(F.broadcast(small), key, how)
    heavy = heavy_keys(big if keys is None else keys, key)
    if not heavy:
        return big.join(small, key, how)
    named = [(k, n) for k, n in heavy.items() if k is not None]
    split = F.broadcast(big.sparkSession.createDataFrame(named, f"{key} {dict(big.dtypes)[key]}, _parts int"))
    many = F.when(F.col(key).isNull(), F.lit(heavy.get(None, 1))).otherwise(F.coalesce("_parts", F.lit(1)))
    big = big.join(split, key, "left").withColumn("_part", F.pmod(F.xxhash64(F.col(spread)), many).cast("int"))
    small = small.join(split, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return big.drop("_parts").join(small.drop("_parts"), [key, "_part"], how).drop("_part")
