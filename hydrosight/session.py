"""Session settings the job relies on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the job wants; applied only where the session has no value yet.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "hydrosight", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.sql.session.timeZone", "UTC")
    for k, v in JOB_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, read from the session.

    Only a session whose tasks run in the driver's own process (``local`` or
    ``local[n]``) and that names no folder gets one of its own; any other must name it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for checkpoints")
        d = tempfile.mkdtemp(prefix="hydrosight-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def materialize(df: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` as a Parquet table in the shared
    checkpoint folder and reading it back; ``tables`` collects the paths.

    One pass (``DataFrame.checkpoint`` computes an unpersisted plan twice:
    once to count, once to write), columnar, and later reads prune columns.
    A lost executor costs a re-read of the table, not a recomputation.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/hydrosight-tables/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    if tables is not None:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, tables: list[str]) -> None:
    """Delete materialized tables; what still reads them fails afterwards."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while tables:
        path = jvm.org.apache.hadoop.fs.Path(tables.pop())
        path.getFileSystem(conf).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, as ``--py-files`` does, once a
    session; a driver that was not started beside it needs that."""
    sc = spark.sparkContext
    if getattr(sc, "_hydrosight_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="hydrosight-package-"), "hydrosight.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "hydrosight")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)  # the driver serves this file to the executors
    sc._hydrosight_shipped = True
