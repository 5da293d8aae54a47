"""Sinks: tables sorted across their files, as CSV or Parquet, and one ordered CSV file."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame

COPY_BYTES = 4 << 20


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sort_by=None,
                single_file: bool = False, mode: str = "overwrite", encoding: str = "UTF-8",
                compression: str | None = None, max_rows: int = 0) -> None:
    """Write ``df``, sorted by ``sort_by`` where given: the rows are dealt by
    ranges and sorted in each, so the files in the order of their names hold
    the table in order.

    ``single_file`` makes one file of it, on request only: for CSV by joining those files
    (``write_single_csv``), for Parquet in one task, which must sort and write the whole table.

    ``compression`` names a codec of the format. Most compressed CSV files are read by one task each:
    ``max_rows`` limits a file's rows, and a task that has more goes on in its next file.
    """
    if single_file and (compression or max_rows):
        raise ValueError("a single file takes no compression or limit of rows")
    if single_file and fmt == "csv":
        if mode != "overwrite":
            raise ValueError("a single file is written in mode overwrite only")
        return write_single_csv(df, path, sort_by, encoding)
    if single_file:
        out = df.repartition(1)
        out = out.sortWithinPartitions(*sort_by) if sort_by else out
    else:
        out = df.orderBy(*sort_by) if sort_by else df
    _write(out, path, fmt, mode, encoding, True, compression, max_rows)


def _write(out: DataFrame, path: str, fmt: str, mode: str, encoding: str, header: bool,
           compression: str | None = None, max_rows: int = 0) -> None:
    w = out.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    if max_rows:
        w = w.option("maxRecordsPerFile", max_rows)
    if fmt == "csv":
        (w.option("header", header)
         .option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False)
         .option("nullValue", "")
         .option("emptyValue", "")
         .option("escape", '"')
         .option("encoding", encoding)
         .csv(path))
    elif fmt == "parquet":
        w.parquet(path)
    elif fmt == "noop":
        w.format("noop").save()
    else:
        raise ValueError(f"unknown sink format {fmt!r}")


def _header(names: list[str], encoding: str) -> bytes:
    quoted = ['"' + n.replace('"', '""') + '"' if re.search(r'[",\r\n]|^\s|\s$', n) else n for n in names]
    return (",".join(quoted) + "\n").encode(encoding)


def write_single_csv(df: DataFrame, path: str, sort_by=None, encoding: str = "UTF-8") -> None:
    """The folder ``path`` with one CSV file, header once, rows in order.

    Tasks sort and write ranges of the rows as files without header beside ``path``; the file system
    then joins them in the order of their names: by ``concat`` where it has that (no byte moves), else as a
    stream through a buffer of 4 MB in the driver. Nothing is sorted or held in one place. What ``path`` held is
    replaced only once the new file is whole. ``encoding`` must be one without a byte order mark.
    """
    if encoding.upper() in ("UTF-16", "UTF-32"):
        raise ValueError(f"{encoding} puts a byte order mark into each part")
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    target = Path(path)
    fs = target.getFileSystem(conf)
    work = Path(f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}")
    try:
        _write(df.orderBy(*sort_by) if sort_by else df, f"{work}/rows", "csv", "error", encoding, header=False)
        found = [s for s in fs.listStatus(Path(work, "rows")) if s.getPath().getName().startswith("part-") and s.getLen()]
        parts = sorted((int(s.getPath().getName().split("-")[1]), s.getPath().getName()) for s in found)
        joined = Path(work, "joined")
        out = fs.create(joined, True)
        try:
            out.write(_header(df.columns, encoding))
        finally:
            out.close()
        _append(spark, fs, joined, [Path(Path(work, "rows"), name) for _, name in parts])
        fs.delete(target, True)
        fs.mkdirs(target)
        if not fs.rename(joined, Path(target, "part-00000.csv")):
            raise OSError(f"could not move the joined file to {path}")
    finally:
        fs.delete(work, True)


def _append(spark, fs, whole, parts: list) -> None:
    """Append the files ``parts`` to the file ``whole``."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    if not parts:
        return
    sources = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
    for i, part in enumerate(parts):
        sources[i] = part
    try:
        fs.concat(whole, sources)
        return
    except UnsupportedOperationException:
        pass
    # a store without concat has no append either: the file is written anew
    head = whole.suffix("-header")
    fs.rename(whole, head)
    out = fs.create(whole, True)
    try:
        for part in [head, *parts]:
            source = fs.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, COPY_BYTES, False)
            finally:
                source.close()
    finally:
        out.close()
