"""What files a source has, asked of the file system itself (any that Spark reads)."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def input_files(spark: SparkSession, paths) -> list[tuple[str, int]]:
    """(path, bytes) of the data files under ``paths`` (files, folders or globs), as Spark's readers
    take them: names that start with ``_`` or ``.`` are not data, nor are subfolders. Empty when nothing is there."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in [paths] if isinstance(paths, str) else list(paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        for top in fs.globStatus(path) or []:
            for status in (fs.listStatus(top.getPath()) if top.isDirectory() else [top]):
                name = status.getPath().getName()
                if status.isFile() and not name.startswith(("_", ".")):
                    found.append((status.getPath().toString(), status.getLen()))
    return sorted(found)


def _place(uri: str) -> tuple[str, str, str]:
    """(scheme, authority, path): ``file:/x`` and ``file:///x`` are one place."""
    return re.fullmatch(r"([^:/]+):(?://([^/]*))?(/.*)", uri).groups("")


def files_with_open_quotes(spark: SparkSession, files: list[str], encoding: str) -> list[str]:
    """Those of ``files`` (as ``input_files`` names them) where a record spans lines: a whole record has an
    even number of quotes, so there, and only there, some line has an odd one. One scan of lines
    that splits files over tasks; a row a file leaves it."""
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1
    lines: DataFrame = spark.read.option("encoding", encoding).text(files)
    found = lines.where(odd).select(F.col("_metadata.file_path").alias("file")).distinct()
    places = {_place(unquote(r["file"])) for r in found.collect()}  # the reader escapes its paths
    return [f for f in files if _place(f) in places]
