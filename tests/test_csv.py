"""CSV edges (S1-S9) and the whole job from CSV files to CSV files."""

import datetime as dt
import os
import tempfile
from urllib.parse import quote

import pytest
import scenario as S
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hydrosight.operators.dedup import keep_first, keep_last
from hydrosight.plans import queries
from hydrosight.plans.job import build
from hydrosight.sources import csv
from hydrosight.sources.csv import numbered, read_optional_csv, read_parcel_csv, read_raw_csv
from hydrosight.sources.manifest import files_with_open_quotes, input_files
from hydrosight.sources.schemas import BILL_COLUMNS, PERSON_COLUMNS, RAW_READ_SCHEMA, READ_COLUMNS
from hydrosight.sources.sinks import write_table
from hydrosight.sources.testdata import Sources, raw_bills, raw_bills_in_order


def _field(v):
    if v is None:
        return ""
    s = str(v)
    if any(ch in s for ch in ',"\n'):
        s = '"' + s.replace('"', '""') + '"'
    return s


def _write(path, header, rows, encoding="latin-1"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(",".join(header) + "\n")
        for row in rows:
            f.write(",".join(_field(v) for v in row) + "\n")


def test_csv_edges(spark):
    d = tempfile.mkdtemp(prefix="hydrosight-csv-")
    rows = [("A1", "P1", "José Nuñez", "x@y", ' "cell" ', "555"),
            ("A1", "P2", "two\nlines", "", "HM", "007")]
    _write(f"{d}/person.csv", [c.lower() for c in PERSON_COLUMNS], rows)
    df = read_raw_csv(spark, f"{d}/person.csv", multiline=True)
    assert [c for c in df.columns if c != "_ord"] == PERSON_COLUMNS          # header folded
    got = {r["PER_ID"]: r for r in df.collect()}
    assert got["P1"]["ENTITY_NAME"] == "José Nuñez"                          # Latin-1 decoded
    assert got["P1"]["PHONE_TYPE_CD"] == ' "cell" '                          # doubled quotes
    assert got["P2"]["ENTITY_NAME"] == "two\nlines"                          # quoted newline
    assert got["P2"]["EMAILID"] is None and got["P2"]["PHONE"] == "007"      # '' -> null, zeros kept
    assert read_optional_csv(spark, f"{d}/missing.csv", RAW_READ_SCHEMA) is None


def test_files_of_other_column_order_fail(spark):
    d = tempfile.mkdtemp(prefix="hydrosight-csv-")
    _write(f"{d}/a.csv", ["SP_ID", "ACCT_ID"], [("1", "A")])
    _write(f"{d}/b.csv", ["ACCT_ID", "SP_ID"], [("B", "2")])
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_raw_csv(spark, d).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_raw_csv(spark, d, with_order=False).select("SP_ID").collect()


@pytest.mark.parametrize("rows", [[("A", "9\n", "x"), ("B", "1", "y")], [("A", "9", "x\ny")], [("A\nB", "1", "z")]])
def test_quoted_newline_without_multiline_fails(spark, rows):
    d = tempfile.mkdtemp(prefix="hydrosight-csv-")
    _write(f"{d}/a.csv", ["ACCT_ID", "N", "T"], rows)
    for read in (lambda: read_raw_csv(spark, d, with_order=False).select("ACCT_ID").collect(),
                 lambda: read_raw_csv(spark, d).count()):
        with pytest.raises((PySparkException, Py4JJavaError)):
            read()
    assert read_raw_csv(spark, d, multiline=True).count() == len(rows)


def test_broken_row_fails_whatever_is_selected(spark):
    d = tempfile.mkdtemp(prefix="hydrosight-csv-")
    with open(f"{d}/a.csv", "w") as f:
        f.write("A,B,C\n1,2,3\n4,5\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_raw_csv(spark, d, with_order=False).select("A").collect()


def test_sorted_files_hold_the_table_in_order(spark):
    d = tempfile.mkdtemp(prefix="hydrosight-sink-")
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id").cast("string").alias("v"))
    df = df.repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_table(df, f"{d}/many", fmt="csv", sort_by=["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    names = sorted(x for x in os.listdir(f"{d}/many") if x.startswith("part-"))
    assert len(names) > 1
    keys = [int(line.split(",")[0]) for n in names for line in open(f"{d}/many/{n}").read().splitlines()[1:]]
    assert keys == list(range(5000))
    write_table(df, f"{d}/one", sort_by=["k"], single_file=True)
    assert len([x for x in os.listdir(f"{d}/one") if x.startswith("part-")]) == 1
    assert [r.k for r in spark.read.parquet(f"{d}/one").collect()] == list(range(5000))


def test_keep_last_follows_file_order_across_files(spark):
    d = tempfile.mkdtemp(prefix="hydrosight-csv-")
    _write(f"{d}/p1.csv", ["CIS_SP_ID", "OTHER", "LND_SQFOOT"], [("SP1", "x", 1.0), ("SP2", "x", 2.0)])
    _write(f"{d}/p2.csv", ["CIS_SP_ID", "OTHER", "LND_SQFOOT"], [("SP1", "y", 3.0)])
    from hydrosight.operators.summary import clean_parcel
    got = dict(tuple(r) for r in clean_parcel(read_parcel_csv(spark, d)).collect())
    assert got == {"SP1": 3.0, "SP2": 2.0}


@pytest.mark.parametrize("table", [32 << 20, 0])
def test_order_of_files_by_number_and_by_path(spark, tmp_path, monkeypatch, table):
    """Files are numbered by path where their paths fit the broadcast table; beyond it the path orders."""
    monkeypatch.setattr(csv, "FILE_TABLE_BYTES", table)
    names = ["a b.csv", "a.csv", "b+%41.csv", "é.csv", "z.csv"]
    for i, name in enumerate(names):
        rows = [("K", f"{name} {j}") for j in range(3)] + [(f"own {i}", 'two\nlines' if i == 4 else "x")]
        _write(f"{tmp_path}/{name}", ["BSEG_ID", "V"], rows)
    df = read_raw_csv(spark, str(tmp_path), multiline=None)
    assert df.schema["_ord"].dataType["file"].dataType.simpleString() == ("int" if table else "string")
    in_order = sorted(names, key=lambda n: "é.csv" if n == "é.csv" else quote(n, safe="+"))  # as the reader escapes them
    assert [r.V for r in df.where("BSEG_ID = 'K'").orderBy("_ord").collect()] == [
        f"{n} {j}" for n in in_order for j in range(3)]
    assert {r.BSEG_ID: r.V for r in keep_last(df, ["BSEG_ID"]).collect()}["K"] == f"{in_order[-1]} 2"
    assert {r.BSEG_ID: r.V for r in keep_first(df, ["BSEG_ID"]).collect()}["K"] == f"{in_order[0]} 0"
    assert numbered(df).agg(F.min("row_no"), F.max("row_no"), F.count_distinct("row_no")).first()[:] == (1, 20, 20)


def test_job_csv_to_csv(spark):
    d = tempfile.mkdtemp(prefix="hydrosight-e2e-")
    # bills split over two files: the order of files then rows decides keep-last
    half = len(S.BILLS) // 2
    os.makedirs(f"{d}/bills")
    _write(f"{d}/bills/part1.csv", BILL_COLUMNS, [b[:-1] for b in S.BILLS[:half]])
    _write(f"{d}/bills/part2.csv", BILL_COLUMNS, [b[:-1] for b in S.BILLS[half:]])
    _write(f"{d}/person.csv", PERSON_COLUMNS, [p[:-1] for p in S.PEOPLE])
    _write(f"{d}/reads.csv", READ_COLUMNS, S.READS)
    src = Sources(bills=read_raw_csv(spark, f"{d}/bills"), person=read_raw_csv(spark, f"{d}/person.csv"),
                  reads=read_raw_csv(spark, f"{d}/reads.csv", with_order=False))
    r = build(spark, src)
    assert r.diagnostics.first().asDict() == S.EXPECTED_DIAGNOSTICS
    write_table(r.summary, f"{d}/out/summary", fmt="csv", sort_by=["SP_ID", "PER_ID", "ACCT_ID"])
    write_table(r.panel, f"{d}/out/panel", fmt="csv", sort_by=["SP_ID"])
    back = spark.read.option("header", True).csv(f"{d}/out/summary")
    keys = [(x["SP_ID"], x["PER_ID"]) for x in back.collect()]
    assert keys == sorted(keys) == [("SP1", "P1"), ("SP1", "P2"), ("SP4", "P4")]
    panel = spark.read.option("header", True).csv(f"{d}/out/panel")
    assert [x["SP_ID"] for x in panel.collect()] == ["SP1", "SP2", "SP4"]
    assert len(os.listdir(f"{d}/out/summary")) >= 1


def test_command_line_runner(spark, capsys):
    from hydrosight.__main__ import parse_args, run
    d = tempfile.mkdtemp(prefix="hydrosight-cli-")
    _write(f"{d}/consumption.csv", BILL_COLUMNS, [b[:-1] for b in S.BILLS])
    _write(f"{d}/person.csv", PERSON_COLUMNS, [p[:-1] for p in S.PEOPLE])
    _write(f"{d}/drc.csv", READ_COLUMNS, S.READS)
    _write(f"{d}/parcel.csv", ["CIS_SP_ID", "LND_SQFOOT"], [("SP1", 7000.0), ("SP1", 7100.0)])
    args = parse_args(["--consumption", f"{d}/consumption.csv", "--person", f"{d}/person.csv",
                       "--drc", f"{d}/drc.csv", "--parcel", f"{d}/parcel.csv",
                       "--out-summary", f"{d}/out/s", "--out-weekly", f"{d}/out/w"])
    r = run(spark, args)
    back = spark.read.option("header", True).csv(f"{d}/out/s").collect()
    assert [x["LND_SQFOOT"] for x in back if x["SP_ID"] == "SP1"] == ["7100.0", "7100.0"]
    assert {x["metric"]: x["value"] for x in r.report.collect()}["drc_rows"] == len(S.READS)
    missing = parse_args(["--consumption", f"{d}/consumption.csv", "--person", f"{d}/person.csv",
                          "--drc", f"{d}/none.csv", "--parcel", f"{d}/no-parcel.csv", "--out-summary", f"{d}/o2/s", "--out-weekly", f"{d}/o2/w"])
    r2 = run(spark, missing)   # absent read file: zeros, like no file at all
    assert r2.diagnostics.first()["raw_drc_rows"] == 0


def test_files_with_quoted_newlines_are_found(spark):
    """Only the files that need it are read whole; order and values are those of one reader."""
    d = tempfile.mkdtemp(prefix="hydrosight-csv-")
    rows = [("1", "plain"), ("2", 'a "quoted" word'), ("3", "ünï")]
    _write(f"{d}/a.csv", ["SP_ID", "ACCT_ID"], rows)
    _write(f"{d}/b c%20.csv", ["SP_ID", "ACCT_ID"], [("4", "two\nlines"), ("5", "three\n\nlines"), ("6", 'end"\n')])
    open(f"{d}/empty.csv", "w").close()
    files = [f for f, size in input_files(spark, d) if size]
    assert len(files) == 2 and len(input_files(spark, d)) == 3
    assert [os.path.basename(f) for f in files_with_open_quotes(spark, files, "ISO-8859-1")] == ["b c%20.csv"]
    got = read_raw_csv(spark, d, multiline=None).orderBy("SP_ID")
    assert [(r.SP_ID, r.ACCT_ID) for r in got.collect()] == rows + [("4", "two\nlines"), ("5", "three\n\nlines"), ("6", 'end"\n')]
    assert [r.SP_ID for r in got.orderBy("_ord").collect()] == ["1", "2", "3", "4", "5", "6"]
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_raw_csv(spark, d, multiline=False).collect()


def test_headers_of_two_orders_fail_also_when_readers_differ(spark):
    d = tempfile.mkdtemp(prefix="hydrosight-csv-")
    _write(f"{d}/a.csv", ["SP_ID", "ACCT_ID"], [("1", "A")])
    _write(f"{d}/b.csv", ["ACCT_ID", "SP_ID"], [("B\nB", "2")])
    with pytest.raises(ValueError):
        read_raw_csv(spark, d, multiline=None)


def test_absent_and_empty_sources(spark):
    d = tempfile.mkdtemp(prefix="hydrosight-csv-")
    for path in (d, f"{d}/missing", f"{d}/*.csv", [f"{d}/x.csv", d]):
        assert read_optional_csv(spark, path, RAW_READ_SCHEMA) is None
        assert read_parcel_csv(spark, path) is None
    open(f"{d}/_SUCCESS", "w").write("x")
    open(f"{d}/zero.csv", "w").close()
    assert read_optional_csv(spark, d, RAW_READ_SCHEMA) is None
    _write(f"{d}/a.csv", READ_COLUMNS, [("SP1", "2024-06-01 00:00", "2024-06-02 00:00", 1, "CCF", 1)])
    assert read_optional_csv(spark, d, RAW_READ_SCHEMA).count() == 1


def _one_file(folder):
    names = [x for x in os.listdir(folder) if x.startswith("part-")]
    assert len(names) == 1
    with open(os.path.join(folder, names[0]), "rb") as f:
        return f.read()


def test_single_file_joins_sorted_parts_under_one_header(spark, tmp_path):
    df = spark.range(5_000).select(((F.col("id") * 7919) % 5_000).alias("k"), F.lit('a "b"\u00e9, c').alias('odd,"name'))
    path = str(tmp_path / "one")
    for _ in range(2):  # the second replaces the first
        write_table(df.repartition(6), path, fmt="csv", sort_by=["k"], single_file=True, encoding="ISO-8859-1")
    lines = _one_file(path).decode("latin-1").splitlines()
    assert lines[0] == 'k,"odd,""name"' and [int(x.split(",")[0]) for x in lines[1:]] == list(range(5_000))
    assert sorted(os.listdir(tmp_path)) == ["one"]  # no parts are left
    back = read_raw_csv(spark, path, fold_header=False)
    assert back.where(F.col('`odd,"name`') == 'a "b"\u00e9, c').count() == 5_000


def test_single_file_of_an_empty_table_is_its_header(spark, tmp_path):
    path = str(tmp_path / "none")
    write_table(spark.createDataFrame([], "a int, b string"), path, fmt="csv", sort_by=["a"], single_file=True)
    assert _one_file(path) == b"a,b\n"


def test_single_file_keeps_the_old_one_when_the_rows_fail(spark, tmp_path):
    path = str(tmp_path / "kept")
    write_table(spark.range(3), path, fmt="csv", sort_by=["id"], single_file=True)
    with pytest.raises(Exception):
        write_table(spark.range(3).select(F.raise_error(F.lit("bad")).alias("id")), path, fmt="csv", single_file=True)
    assert _one_file(path) == b"id\n0\n1\n2\n" and sorted(os.listdir(tmp_path)) == ["kept"]
    with pytest.raises(ValueError, match="overwrite"):
        write_table(spark.range(3), path, fmt="csv", single_file=True, mode="append")


def test_rows_are_numbered_over_files_and_splits(spark, tmp_path):
    path = str(tmp_path / "many")
    write_table(spark.range(4_000).withColumn("t", F.lit("x" * 40)).repartition(5), path, fmt="csv", sort_by=["id"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        got = numbered(read_raw_csv(spark, path)).select(F.col("ID").cast("bigint"), "row_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r[0]: r[1] for r in got} == {i: i + 1 for i in range(4_000)}


def _write_bill_tables(spark, folder):
    """300 rows, some of a key that comes again, some with nulls; ``_ord`` differs in its last fields only."""
    days = [dt.datetime(1992, 1, 1) + dt.timedelta(days=37 * i % 11) for i in range(300)]
    rows = [(i % 40, i % 3, i % 2, None if i % 53 == 0 else i % 4, float(i % 5), 10.0, 0.1, i / 1000,
             None if i % 17 == 0 else "ANR"[i % 3], "FO"[i % 2], None if i % 29 == 0 else days[i]) for i in range(300)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                          "l_shipdate timestamp_ntz").repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    orders = [(i, 7 * i) for i in range(35)]  # five orders are missing
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{folder}/orders.parquet")


def test_sorted_bills_are_the_raw_bills_and_only_their_numbers_are_sorted(spark, tmp_path):
    _write_bill_tables(spark, tmp_path)
    got, want = raw_bills_in_order(spark, str(tmp_path)), raw_bills(spark, str(tmp_path)).orderBy("_ord").drop("_ord")
    assert got.columns == BILL_COLUMNS
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    above, sort, below = got._jdf.queryExecution().optimizedPlan().toString().partition("Sort [")
    assert sort and "BSEG_ID" in above and "BSEG_ID" not in below and "concat" not in below.replace("concat(l_returnflag", "")


def test_bill_files_hold_all_bills_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "FILE_ROWS", 20)
    _write_bill_tables(spark, tmp_path)
    want = [tuple(r) for r in raw_bills_in_order(spark, str(tmp_path)).collect()]
    path = queries._csv_copy(spark, raw_bills_in_order(spark, str(tmp_path)), BILL_COLUMNS, "bills", str.lower)
    back = numbered(read_raw_csv(spark, path)).orderBy("row_no")
    assert [tuple(v or "" for v in r) for r in back.select(*BILL_COLUMNS).collect()] == [
        tuple(v or "" for v in r) for r in want]
    sizes = back.groupBy("_ord.file").count().collect()
    assert len(sizes) >= len(want) / 20 and max(r["count"] for r in sizes) <= 20
    assert all(f.endswith(".csv.gz") for f, size in input_files(spark, path) if size)


def test_single_file_takes_no_limit_of_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="single file"):
        write_table(spark.range(3), str(tmp_path / "x"), fmt="csv", single_file=True, max_rows=2)
