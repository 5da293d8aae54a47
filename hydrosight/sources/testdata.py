"""Utility inputs derived from the supplied parquet tables.

The supplied tables hold no utility data, so bills, contacts, interval reads
and parcels are derived from ``lineitem``/``orders``, ``customer`` and
``events`` by fixed deterministic rules. The derived tables look like the raw
CSV inputs (text ids and timestamps, quantities as numbers) plus ``_ord``,
the order that keep-first/keep-last follows. Every row of the supplied tables is
used, and nothing is computed here: the work grows with the tables.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrosight.sources.schemas import ORD


@dataclass
class Sources:
    bills: DataFrame
    person: DataFrame
    reads: DataFrame | None = None
    parcel: DataFrame | None = None


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pad7(c: Column) -> Column:
    """Zero-padded to at least 7 digits; longer numbers stay whole."""
    n = c.cast("bigint").cast("string")
    return F.when(F.length(n) < 7, F.lpad(n, 7, "0")).otherwise(n)


def _ntz(s: str) -> Column:
    return F.lit(_dt.date.fromisoformat(s)).cast("timestamp_ntz")


#: the order that keep-last follows, as fields of ``_ord``
_BILL_ORDER = ["end", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _bill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a bill, as numbers: what the text of ``_bill_text`` is made of. What needs ``lineitem``
    alone is reduced before the join, so that its exchange carries no more than that."""
    flag = F.concat(F.col("l_returnflag"), F.col("l_linestatus"))
    sa_type = (F.when(flag == "AF", 0).when(flag == "AO", 1).when(flag == "NF", 2).when(flag == "NO", 3)
               .when(flag == "RF", 4).otherwise(5))
    end_day = F.date_add(F.lit(_dt.date(2024, 3, 15)),
                         F.datediff(F.col("l_shipdate").cast("date"), F.lit(_dt.date(1992, 1, 1))) % 365)
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", end_day.alias("end"), *_BILL_ORDER[1:],
                                              sa_type.cast("tinyint").alias("sa_type"))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey, "inner").drop("o_orderkey")


def _bill_text(rows: DataFrame, *more: Column) -> DataFrame:
    """``_bill_rows`` as raw bills, with further columns."""
    start_day = F.date_sub("end", F.lit(18) + (F.col("l_partkey") % 25).cast("int"))
    sa_type = F.lit("ERES")
    for n, text in enumerate([" wres ", "WRES", "WRESSEW", "WRESIRR", "WRECRES"]):
        sa_type = F.when(F.col("sa_type") == n, text).otherwise(sa_type)
    boost = F.when(F.month("end").between(4, 9) & (F.col("o_custkey") % 3 == 0), 4).otherwise(1)
    return rows.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("BSEG_ID"),
        F.concat(F.lit(" SP"), _pad7(F.col("o_custkey"))).alias("SP_ID"),
        F.col("l_suppkey").cast("string").alias("SA_ID"),
        F.concat(F.lit("A"), _pad7(F.col("o_custkey") + F.when(F.col("l_linenumber") == 7, 1).otherwise(0)),
                 F.lit(" ")).alias("ACCT_ID"),
        sa_type.alias("SA_TYPE_CD"),
        F.when(F.col("l_partkey") % 10 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("P"), (F.col("o_custkey") + F.col("l_partkey") % 2).cast("string")))
        .alias("CHAR_PREM_ID"),
        F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("PREM_ID"),
        F.lit("").alias("ADDRESS1"),
        (F.col("l_quantity") * boost).cast("string").alias("FINAL_REG_QTY"),
        start_day.cast("timestamp_ntz").cast("string").alias("START_READ_DTTM"),
        F.col("end").cast("timestamp_ntz").cast("string").alias("END_READ_DTTM"),
        F.lit("CCF").alias("FINAL_UOM_CD"),
        *more,
    )


def raw_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bill_text(_bill_rows(spark, sf_dir), F.struct(
        F.col("end").cast("timestamp_ntz").alias("end"), *_BILL_ORDER[1:]).alias(ORD))


def raw_bills_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_bills`` sorted by ``_ord``, without that column. The numbers are sorted, the text is
    made of the sorted rows: the sort exchanges about half of the bytes."""
    return _bill_text(_bill_rows(spark, sf_dir).orderBy(*_BILL_ORDER))


def raw_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    phone_type = (F.when(seg == "AUTOMOBILE", "mob").when(seg == "BUILDING", " HM ")
                  .when(seg == "FURNITURE", "Business").when(seg == "HOUSEHOLD", "CEL")
                  .when(seg == "MACHINERY", "fax"))
    key = F.col("c_custkey")
    # some accounts match no bill, so some candidates have no person
    account = F.concat(F.when((key % 11).isin(0, 1), "N").otherwise("A"), _pad7(key))

    def part(order: int, per_suffix: str, phone: Column) -> Column:
        return F.struct(
            account.alias("ACCT_ID"),
            F.concat(F.lit("R"), key.cast("string"), F.lit(per_suffix)).alias("PER_ID"),
            F.col("c_name").alias("ENTITY_NAME"),
            F.concat(F.lit("USER"), key.cast("string"), F.lit("@EXAMPLE.ORG")).alias("EMAILID"),
            phone_type.alias("PHONE_TYPE_CD"),
            phone.alias("PHONE"),
            F.lit(order).alias(ORD),
        )

    base_phone = F.concat(F.lit("555-"), F.lpad((key % 10000).cast("string"), 4, "0"))
    parts = F.array_compact(F.array(
        part(0, "", base_phone),
        F.when(key % 7 == 0, part(1, "", F.lit("555-DUP"))),
        F.when(key % 5 == 0, part(2, "B", base_phone)),
    ))
    # one narrow pass: each customer row yields its one to three person rows
    return c.select(F.inline(parts))


def raw_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _t(spark, sf_dir, "events")
    secs = (F.col("ts") - _ntz("2024-01-01")).cast("interval second").cast("bigint")
    hours = F.floor(secs * 7 / 3600).cast("int")
    begin = _ntz("2024-03-20") + F.make_dt_interval(F.lit(0), hours, F.lit(0), F.lit(0))
    et = F.col("event_type")
    minutes = (F.when(et == "click", 15).when(et == "view", 60).when(et == "purchase", 1440)
               .when(et == "signup", 28800).otherwise(0))
    end = begin + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))
    unit_pick = F.col("event_id") % 5
    uom = F.when(unit_pick.isin(0, 1), "CCF").when(unit_pick.isin(2, 3), "GAL").otherwise("XX")
    return ev.select(
        F.concat(F.lit("SP"), _pad7(F.col("user_id"))).alias("SP_ID"),
        begin.cast("string").alias("BEGIN_READ_DTTM"),
        end.cast("string").alias("END_READ_DTTM"),
        F.when(uom == "GAL", F.col("value") * 748).otherwise(F.col("value")).alias("CONSUMPTION"),
        uom.alias("UOM"),
        F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("double")).otherwise(F.lit(1.0))
        .alias("MULTIPLIER"),
    )


def raw_parcel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    # some parcels match no service point, so some service points have no parcel
    sp = F.concat(F.when(F.col("c_custkey") % 4 == 0, "NP").otherwise("SP"), _pad7(F.col("c_custkey")))
    lot = F.lit(5000.0) + F.abs(F.col("c_acctbal"))
    parts = F.array_compact(F.array(
        F.struct(sp.alias("CIS_SP_ID"), lot.alias("LND_SQFOOT"), F.lit(0).alias(ORD)),
        F.when(F.col("c_custkey") % 6 == 0,
               F.struct(sp.alias("CIS_SP_ID"), (lot + 1).alias("LND_SQFOOT"), F.lit(1).alias(ORD))),
    ))
    return c.select(F.inline(parts))


def testdata_sources(spark: SparkSession, sf_dir: str, with_reads: bool = True,
                     with_parcel: bool = False) -> Sources:
    return Sources(
        bills=raw_bills(spark, sf_dir),
        person=raw_person(spark, sf_dir),
        reads=raw_reads(spark, sf_dir) if with_reads else None,
        parcel=raw_parcel(spark, sf_dir) if with_parcel else None,
    )
