import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from rows import BILL_SCHEMA, PERSON_SCHEMA, RAW_READ_SCHEMA  # noqa: E402

from hydrosight.session import ensure_checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.ansi.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not (s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="hydrosight-test-"))
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture
def make(spark):
    class Make:
        def bills(self, rows):
            return spark.createDataFrame(rows, BILL_SCHEMA)

        def people(self, rows):
            return spark.createDataFrame(rows, PERSON_SCHEMA)

        def reads(self, rows):
            return spark.createDataFrame(rows, RAW_READ_SCHEMA)
    return Make()
