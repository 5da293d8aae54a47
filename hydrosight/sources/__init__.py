"""Sources and sinks: raw CSV inputs, the supplied test tables, outputs."""

from hydrosight.sources.csv import numbered, read_optional_csv, read_parcel_csv, read_raw_csv
from hydrosight.sources.sinks import write_table
from hydrosight.sources.testdata import (
    Sources,
    raw_bills,
    raw_parcel,
    raw_person,
    raw_reads,
    testdata_sources,
)

__all__ = [
    "Sources",
    "numbered",
    "raw_bills",
    "raw_parcel",
    "raw_person",
    "raw_reads",
    "read_optional_csv",
    "read_parcel_csv",
    "read_raw_csv",
    "testdata_sources",
    "write_table",
]
