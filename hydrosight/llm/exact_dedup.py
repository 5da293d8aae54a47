"""Exact de-duplication against a persistent digest index.

The index is a table (digest, keep_id) bucketed and sorted by digest, one row
per distinct text. A batch of rows is reduced to one row per digest before
it is shuffled, met with the index in a sort-merge anti-join that leaves the
index where it lies, and only the digests that are new are appended. An index has
one writer at a time. Without one given, the batch has its own, which is removed.

Defined cases
    null text            counts as the empty text
    null doc_id          never stays for a copy that has an id; a group of
                         null ids only has keep_id null and stays whole
    very long text       hashed whole by a JVM function
    repeated rows        rows of one doc_id are one document: equal rows get
                         equal decisions, group_size counts them all
    empty table          empty result; nothing is appended
    clashing columns     only the id and text columns are read
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrosight.llm.common import WS, cut, parallelism, scratch
from hydrosight.session import drop_tables


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """A bucketed table of digests. ``buckets`` is fixed when the table is
    made: choose it so that one bucket of the expected index fits a task."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None,
                 buckets: int | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or parallelism(spark)
        if not spark.catalog.tableExists(name):
            empty = spark.createDataFrame([], "digest binary, keep_id bigint")
            self._write(empty, path)

    def _write(self, rows: DataFrame, path: str | None = None, name: str | None = None) -> None:
        w = rows.write.bucketBy(self.buckets, "digest").sortBy("digest")
        if path:
            w = w.option("path", path)
        w.mode("append").saveAsTable(name or self.name)

    def read(self) -> DataFrame:
        return self.spark.read.table(self.name)

    def place(self) -> str:
        """The folder of the table's files."""
        return self.spark.sql(f"DESCRIBE FORMATTED {self.name}").where("col_name = 'Location'").first()["data_type"]

    def drop(self) -> None:
        """Remove the table and its files."""
        place = self.place()
        self.spark.sql(f"DROP TABLE {self.name}")
        drop_tables(self.spark, [place])

    def compact(self) -> None:
        """Rewrite the table with one sorted file a bucket; each ``add`` leaves one more. Like
        ``add`` for the one writer of the index: two at once could both add a digest, and readers wait."""
        mark = uuid.uuid4().hex[:12]
        files = self.spark.read.schema(self.read().schema).parquet(self.place())  # unbucketed: it needs the exchange
        self._write(files.repartition(self.buckets, "digest"), f"{self.place()}-{mark}", f"{self.name}_{mark}")
        self.drop()
        self.spark.sql(f"ALTER TABLE {self.name}_{mark} RENAME TO {self.name}")

    def add(self, batch: DataFrame) -> None:
        """Append the digests of ``batch`` (digest, keep_id; one row each)
        that the index does not hold."""
        known = self.read().select("digest").hint("merge")
        new = batch.select("digest", "keep_id").join(known, "digest", "left_anti")
        # digests reach the writer in the buckets of the anti-join: one file each
        self._write(cut(new.repartition(self.buckets, "digest"), "new-digests")
                    .repartition(self.buckets, "digest"))


def exact_dedup(df: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows equal to a text the index holds are copies of that text's document;
    of new equal texts the row with the smallest id stays.
    """
    spark = df.sparkSession
    private = index is None
    if private:
        name = f"digest_index_{uuid.uuid4().hex[:12]}"
        index = DigestIndex(spark, name, path=scratch(spark, name))
    rows = cut(df.select(F.col(id_col).cast("bigint").alias("doc_id"),
                         digest(F.col(text_col)).alias("digest")), "digests")
    batch = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"),
                                           F.count(F.lit(1)).alias("group_size")), "digest-groups")
    index.add(batch)
    stays = cut(batch.drop("keep_id").join(index.read().hint("merge"), "digest"), "digest-stays")
    # the rows of a hot digest are split by AQE: both sides are plain shuffles
    if private:
        index.drop()  # ``stays`` has been written
    return rows.join(stays, "digest").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
