"""CSV inputs (Latin-1 text with a header).

Every column is read as text: ids keep their leading zeros whatever the
header case, and the cleaning step casts strictly. ``_ord`` records file
order as (file, split start, position in the split); keep-first and
keep-last follow it, so de-duplication does not depend on how the files are
split over tasks. The file is its number by path, so that sorts and shuffles carry
20 bytes a row in place of a path; the table of numbers is broadcast up to
``FILE_TABLE_BYTES`` of paths, and beyond them the path itself stands there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrosight.sources.manifest import files_with_open_quotes, input_files
from hydrosight.sources.schemas import ORD

#: paths that are numbered through a broadcast table
FILE_TABLE_BYTES = 32 << 20


def _reader(spark: SparkSession, encoding: str, multiline: bool):
    return (spark.read.format("csv")
            .option("header", True)
            .option("inferSchema", False)
            .option("encoding", encoding)
            .option("nullValue", "")
            .option("quote", '"')
            .option("escape", '"')
            .option("multiLine", multiline)
            # each file's header must name the columns in one order, and each
            # record must have as many fields: else the read fails. Fields are
            # parsed whole for that, whatever the query takes of them
            .option("enforceSchema", False)
            .option("columnPruning", False)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .option("mode", "FAILFAST"))


def _load(spark: SparkSession, paths, encoding: str, multiline: bool | None) -> list[DataFrame]:
    """The files as one frame, or two where only some need the reader that does not split files."""
    if multiline is not None:
        return [_reader(spark, encoding, multiline).load(paths)]
    files = [f for f, size in input_files(spark, paths) if size]
    if not files:
        return [_reader(spark, encoding, False).load(paths)]
    whole = files_with_open_quotes(spark, files, encoding)
    parts = [(False, sorted(set(files) - set(whole))), (True, whole)]
    frames = [_reader(spark, encoding, span).load(fs) for span, fs in parts if fs]
    if any(f.columns != frames[0].columns for f in frames):
        raise ValueError("the files' headers name other columns or another order")
    return frames


def _with_order(frames: list[DataFrame]) -> list[DataFrame]:
    """The frames of one source, with ``_ord`` over the files of all of them."""
    files = sorted({f for frame in frames for f in frame.inputFiles()})
    numbers = None
    if sum(map(len, files)) <= FILE_TABLE_BYTES:
        # a place without an authority is written ``file:/x`` or ``file:///x``: both spellings stand there
        spelt = {(n, re.sub("^([^:/]+):/(?://)?(?=[^/])", rf"\1:{bar}", f)) for n, f in enumerate(files) for bar in ("/", "///")}
        numbers = F.broadcast(frames[0].sparkSession.createDataFrame(sorted(spelt), f"{ORD}_file int, {ORD}_path string"))
    out = []
    for frame in frames:
        rows = frame.select("*", F.col("_metadata.file_path").alias(f"{ORD}_at"),
                            F.col("_metadata.file_block_start").alias(f"{ORD}_start"),
                            F.monotonically_increasing_id().alias(f"{ORD}_row"))
        file = F.col(f"{ORD}_at")
        if numbers is not None:
            rows = rows.join(numbers, rows[f"{ORD}_at"] == numbers[f"{ORD}_path"], "left")
            file = F.coalesce(f"{ORD}_file", F.raise_error(F.concat(F.lit("not a listed file: "), file)).cast("int"))
        out.append(rows.select(*frame.columns, F.struct(
            file.alias("file"), F.col(f"{ORD}_start").alias("start"), F.col(f"{ORD}_row").alias("row")).alias(ORD)))
    return out


def read_raw_csv(spark: SparkSession, paths, encoding: str = "ISO-8859-1",
                 multiline: bool | None = False, fold_header: bool = True,
                 with_order: bool = True) -> DataFrame:
    """All-text scan; header names upper-cased; ``_ord`` = file order.

    ``multiline=None`` finds the files with quoted newlines by one scan of their lines: those are
    read whole, each by one task, all others are split. False splits all files (a record that
    spans lines then fails the read), True none.

    ``with_order=False`` for inputs that are never de-duplicated (reads):
    the row id is non-deterministic, so it would keep filters out of the
    CSV scan."""
    frames = _load(spark, paths, encoding, multiline)
    if with_order:
        frames = _with_order(frames)
    df = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    if fold_header:
        df = df.toDF(*[c if c == ORD else c.upper() for c in df.columns])
    return df


def read_optional_csv(spark: SparkSession, paths, schema: T.StructType, **kw) -> DataFrame | None:
    """A source that may be absent. None when no path is given or no file with data is there."""
    if paths is None or not any(size for _, size in input_files(spark, paths)):
        return None
    return read_raw_csv(spark, paths, **kw)


def read_parcel_csv(spark: SparkSession, paths, encoding: str = "UTF-8",
                    multiline: bool | None = False) -> DataFrame | None:
    """Two columns of a wide file. Header case is kept: names match
    exactly. None when no path is given or no file exists."""
    if paths is None or not any(size for _, size in input_files(spark, paths)):
        return None
    frames = [f.select("CIS_SP_ID", "LND_SQFOOT", ORD) for f in _with_order(_load(spark, paths, encoding, multiline))]
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def numbered(df: DataFrame, name: str = "row_no") -> DataFrame:
    """``df`` of ``read_raw_csv`` with the place of each row, from 1, in the files in the order of their names.

    A count a split of the files and a running sum over those (a row a split in one task) give each
    split's first place; rows are only joined with that."""
    at = df.select("*", F.col(f"{ORD}.file").alias("_file"), F.col(f"{ORD}.start").alias("_start"),
                   F.col(f"{ORD}.row").alias("_row"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (at.groupBy("_file", "_start").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    place = F.col("_row") - F.col("_first") + F.col("_before") + 1
    return at.join(splits, ["_file", "_start"]).select(*df.columns, place.alias(name))
