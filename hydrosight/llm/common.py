"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrosight.session import drop_tables, ensure_checkpoint_dir

#: the white space of the text contracts, as a character class body
WS = r"\x20\x09-\x0D"
#: the same characters for ``bytes.strip``
WS_BYTES = b" \t\n\x0b\x0c\r"
#: remainder of crc32(doc_id as text) mod 4 that is held out from learning
FOLDS, HELD_OUT = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the
    lineage ends there, and a lost executor costs a re-read."""
    path = scratch(df.sparkSession, name)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: what Arrow calls the stores that Hadoop names otherwise; a scheme that both name alike stands for itself
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
ARROW_KNOWN = {"file", "s3", "gs", "gcs", "abfs", "abfss", "hdfs", "viewfs"}


def arrow_uri(uri: str) -> str:
    """The Hadoop URI or absolute path ``uri`` as Arrow's file systems take it. Raises where Arrow has no such store."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", uri)
    if not found:
        return uri
    scheme, rest = found[1].lower(), uri[found.end():]
    if scheme == "dbfs":  # mounted on every node
        return "file:///dbfs/" + rest.lstrip("/")
    if scheme in ("wasb", "wasbs"):
        rest = rest.replace(".blob.core.", ".dfs.core.", 1)
    scheme = ARROW_SCHEMES.get(scheme, scheme)
    if scheme not in ARROW_KNOWN:
        raise ValueError(f"tasks cannot write files to {uri!r}: Arrow has no file system for {found[1]!r}; "
                         f"name a folder of {', '.join(sorted(ARROW_KNOWN | set(ARROW_SCHEMES) | {'dbfs'}))} "
                         "in spark.checkpoint.dir")
    return f"{scheme}:{rest}"


def arrow_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a Hadoop URI, in a task; credentials and regions are those of the task's environment."""
    return pafs.FileSystem.from_uri(arrow_uri(uri))


def scratch_files(spark: SparkSession, name: str) -> str:
    """``scratch`` for files that tasks write themselves: fails before the first stage where they could not."""
    path = scratch(spark, name)
    arrow_uri(path)
    return path


def held_out(doc_id: Column) -> Column:
    """True for the documents whose labels may not be learned from. A null id
    counts as the empty text (remainder 0)."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == HELD_OUT


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows that a task hands to Python at once, for operators on whole texts: a
    batch is held several times over. A session that sets its own number keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.sparkContext.getConf().get(key) is None and spark.conf.get(key) == "10000":
        spark.conf.set(key, rows)


@contextmanager
def small_batches(spark: SparkSession, megabytes: int = 16):
    """Bounds the bytes that a task hands to Python at once, for jobs started inside;
    the session's own value comes back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(megabytes << 20))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that the operators of this session wrote in the shared folder;
    results that still read it cannot be read afterwards."""
    drop_tables(spark, [f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm"])
