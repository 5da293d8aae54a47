"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrosight.llm.common import held_out, scratch_files, table
from hydrosight.llm.embed_join import near_duplicates
from hydrosight.llm.exact_dedup import exact_dedup
from hydrosight.llm.filter_audit import filter_audit
from hydrosight.llm.jaccard import jaccard_components
from hydrosight.llm.langid import language_id
from hydrosight.llm.line_dedup import line_dedup
from hydrosight.llm.mixing import mix
from hydrosight.llm.packing import pack
from hydrosight.llm.quality import quality
from hydrosight.llm.source_audit import source_audit
from hydrosight.llm.substring_dedup import substring_dedup
from hydrosight.llm.toxicity import toxicity
from hydrosight.llm.warc import read_warc, write_warc


#: target weights of the mixture; nodes that are not named weigh 1
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def mixing_levels() -> dict:
    """The tree over ``documents``: the table names no domain, so the number at
    the end of a source stands for one (number mod 4; d0 without a number)."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]{1,9})$", 1)
    return {"domain": F.concat(F.lit("d"), F.coalesce(
                F.when(number != "", number.cast("int")) % 4, F.lit(0)).cast("string")),
            "lang": F.col("lang"), "source": F.col("source")}


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs, mixing_levels(), WEIGHTS, budget_share=(1, 1), max_epochs=4, seed=7).select(
        "doc_id", "lang", "source", "epoch", "tokens", "take")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_warc(table(spark, sf_dir, "pages"), scratch_files(spark, "warc"), min_bytes=0)
    return read_warc(index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), percent=75)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    scored = quality(docs, table(spark, sf_dir, "labels"), threshold=0.1)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, min_chars=40, min_docs=5).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer or tokenizer_file(), size=1024, special=True)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(table(spark, sf_dir, "documents"), min_docs=30, top=50)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), span=50).drop("spans")


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_mixing, op3_warc, op4_language_id, op5_jaccard, op6_quality, op7_line_dedup, op8_packing,
    op9_exact_dedup, op10_embeddings, op11_source_audit, op12_filter_audit, op13_substring_dedup)}
