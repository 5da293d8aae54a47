"""Rows of the raw inputs, for tests."""

from pyspark.sql import types as T

from hydrosight.sources.schemas import BILL_COLUMNS, ORD, PERSON_COLUMNS, RAW_READ_SCHEMA

__all__ = ["BILL_SCHEMA", "PERSON_SCHEMA", "RAW_READ_SCHEMA", "bill", "person", "read"]

BILL_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in BILL_COLUMNS]
                           + [T.StructField(ORD, T.LongType())])
PERSON_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in PERSON_COLUMNS]
                             + [T.StructField(ORD, T.LongType())])


def bill(bseg, sp, acct, typ, qty, start, end, prem=None, ord_=0, sa="1"):
    return (bseg, sp, sa, acct, typ, prem, "P", "", None if qty is None else str(qty), start, end,
            "CCF", ord_)


def person(acct, per, name="N", email="E@X.ORG", ptype="CELL", phone="555", ord_=0):
    return (acct, per, name, email, ptype, phone, ord_)


def read(sp, begin, end, qty, uom="CCF", mult=1.0):
    return (sp, begin, end, qty, uom, mult)
