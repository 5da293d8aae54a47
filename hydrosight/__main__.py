"""Run the whole job on files: ``python -m hydrosight --consumption ... --person ...``.

Reads the CSV inputs (the read and parcel files are optional and may be
missing), writes the summary and the weekly panel (sorted CSV or Parquet
files), prints the run report (the 14 counters and the row count of each
source) and deletes its intermediate tables.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from hydrosight.params import Params
from hydrosight.plans.job import build
from hydrosight.session import build_session, ensure_checkpoint_dir
from hydrosight.sources.csv import read_optional_csv, read_parcel_csv, read_raw_csv
from hydrosight.sources.schemas import RAW_READ_SCHEMA
from hydrosight.sources.sinks import write_table
from hydrosight.sources.testdata import Sources
from hydrosight.operators.summary import SUMMARY_SORT


def parse_args(argv=None) -> argparse.Namespace:
    a = argparse.ArgumentParser(prog="hydrosight", description=__doc__)
    a.add_argument("--consumption", required=True, help="bill CSV file(s) or folder")
    a.add_argument("--person", required=True, help="contact CSV file(s) or folder")
    a.add_argument("--drc", help="interval read CSV file(s) or folder (optional)")
    a.add_argument("--parcel", help="parcel CSV (optional)")
    a.add_argument("--out-summary", required=True)
    a.add_argument("--out-weekly", required=True)
    a.add_argument("--format", choices=["csv", "parquet"], default="csv")
    a.add_argument("--encoding", default="ISO-8859-1")
    a.add_argument("--multiline", choices=["auto", "on", "off"], default="auto",
                   help="quoted newlines: found by a scan of the bills', people's and parcels' lines (auto; the reads are "
                        "split, and fail on such a record), allowed everywhere (on: no file is split) or nowhere (off)")
    a.add_argument("--ts-format", action="append", default=[], metavar="[COLUMN=]PATTERN",
                   help="timestamp pattern, form (such as M/D/Y) or \"infer\", of one column or of all others "
                        "(default: ISO text)")
    a.add_argument("--single-file", action="store_true", help="one output file each (CSV: sorted parts joined; Parquet: through one task)")
    a.add_argument("--master", default=None)
    return a.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace):
    ensure_checkpoint_dir(spark)
    named = [f.split("=", 1) for f in args.ts_format]
    p = Params(ts_format=next((f[0] for f in named if len(f) == 1), None),
               ts_formats=tuple((f[0].upper(), f[1]) for f in named if len(f) == 2))
    multiline = {"auto": None, "on": True, "off": False}[args.multiline]
    kw = {"encoding": args.encoding, "multiline": multiline}
    reads = None
    if args.drc:
        reads = read_optional_csv(spark, args.drc, RAW_READ_SCHEMA, with_order=False,
                                  **kw | {"multiline": bool(multiline)})
    src = Sources(
        bills=read_raw_csv(spark, args.consumption, **kw),
        person=read_raw_csv(spark, args.person, **kw),
        reads=reads,
        parcel=read_parcel_csv(spark, args.parcel, multiline=multiline),
    )
    r = build(spark, src, p)
    write_table(r.summary, args.out_summary, fmt=args.format, sort_by=SUMMARY_SORT, single_file=args.single_file)
    write_table(r.panel, args.out_weekly, fmt=args.format, sort_by=["SP_ID"], single_file=args.single_file)
    return r


def main(argv=None) -> int:
    args = parse_args(argv)
    spark = build_session(args.master)
    r = run(spark, args)
    if r.summer_year is None:
        print("no summer bills: no window, no candidates")
    for row in r.report.collect():
        print(f"{row['metric']}={row['value']}")
    r.release()
    return 0


if __name__ == "__main__":
    sys.exit(main())
