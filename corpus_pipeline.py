"""The corpus pipeline: documents that pass the quality classifier lose repeated
lines, one document of each group of near copies stays, sources are mixed to target
weights, and the mixture is packed into sequences.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; its
result is written as Parquet in the shared folder and read as the next one's
documents. All but the last return the columns of ``documents`` (n_chars follows the
text). An empty table gives an empty result at every stage. Null and empty texts are documents
like any other: quality scores them, line dedup makes a null one empty, they link with nothing, go
with whole epochs of the mixture and are packed as their end mark alone. Very long
texts are taken whole. Columns that no operator reads travel in one struct, so a column
of any name (score, kept, take, n_lines and so on) keeps its values and type.

Repeated rows of one doc_id are one document to the choice among near copies: they
all stay when one of them does. Documents without an id stay only where no
document of their group has one. Mixing repeats documents, once an epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrosight.llm.common import cut, table
from hydrosight.llm.jaccard import jaccard_components
from hydrosight.llm.line_dedup import line_dedup
from hydrosight.llm.mixing import mix, prefix
from hydrosight.llm.packing import pack
from hydrosight.llm.quality import quality
from hydrosight.llm.queries import WEIGHTS, mixing_levels, tokenizer_file


#: the columns of documents that operators read
READ = ("doc_id", "text", "lang", "source")


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that no operator reads in one struct, out of the way of theirs."""
    others = [c for c in docs.columns if c not in READ]
    own = [c for c in docs.columns if c in READ]
    return docs.select(*own, F.struct(*others).alias("__row")) if others else docs


def _unpacked(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from a result on ``_packed(docs)``."""
    return result.select(*(F.col(c) if c in READ else F.col("__row")[c].alias(c) for c in docs.columns))


def _like(result: DataFrame, docs: DataFrame) -> DataFrame:
    """``_unpacked``, n_chars by the text."""
    out = _unpacked(result, docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("bigint"))
    return out


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality(_packed(docs), table(spark, sf_dir, "labels"), threshold=0.1)
    return _unpacked(scored.where("kept"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like(line_dedup(_packed(docs), min_chars=40, min_docs=5), docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_components(docs, percent=75)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("__stays")).distinct()
    return docs.join(stay.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(stay["__stays"]),
                     "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix(_packed(docs), mixing_levels(), WEIGHTS, budget_share=(1, 1), max_epochs=4, seed=7)
    text = F.when(F.col("take") < F.col("tokens"), prefix(F.col("text"), F.col("take"))).otherwise(F.col("text"))
    return _like(mixed.withColumn("text", text), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_file(), size=1024)


STAGES = [("quality", quality_stage), ("line-dedup", line_stage), ("near-copies", near_copy_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

#: learned and tokenizing stages: tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
