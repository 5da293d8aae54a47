"""Cases that once gave wrong, unbounded or slow results."""
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrosight.llm import components as C
from hydrosight.llm import jaccard as J
from hydrosight.llm.common import arrow_uri, scratch
from hydrosight.llm.exact_dedup import DigestIndex, exact_dedup
from hydrosight.llm.jaccard import jaccard_components
from hydrosight.llm.langid import language_id
from hydrosight.llm.toxicity import Matcher, features, toxicity


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


def test_alternating_words_are_told_apart(docs):
    """Words that hashes of powers modulo 2^64 cannot tell apart."""
    rows = []
    for k, n in enumerate((512, 1024, 2048, 4096)):
        rows += [(10 * k, thue_morse(n, "a", "b")), (10 * k + 1, thue_morse(n, "b", "a")), (10 * k + 2, thue_morse(n, "A", "b"))]
    got = {r.doc_id: r.component_id for r in jaccard_components(docs(rows)).collect()}
    assert got == {i: i - 2 if i % 10 == 2 else i for i, _ in rows}  # A-Z as a-z is the same word


def test_word_hashes_do_not_depend_on_the_place():
    words = ["a", "é", "b" * 1500, "A", "B" * 1500, "c" * 1024]
    h = J.word_hashes((" \t" + "\n ".join(words) + " ").encode())
    assert len(h) == 6 and h[0] == h[3] and h[2] == h[4] and len(set(h.tolist())) == 4
    for w, x in zip(words, h):
        assert J.word_hashes(w.encode()).tolist() == [x]
    assert len(J.word_hashes(b"")) == len(J.word_hashes(b" \n")) == 0


def test_a_text_of_many_hits_takes_time_in_proportion():
    matcher = Matcher(["idiot", "stupid"], [], 5)
    features("idiot said stupid " * 50, matcher, 50)
    t0 = time.perf_counter()
    f = features('idiot a b c d e said a b c d stupid "idiot" a b c ' * 60_000, matcher, 50)  # 3 MB
    assert time.perf_counter() - t0 < 20 and f[0] > 0 and f[5] > 0


def test_densest_window_by_brute_force():
    matcher = Matcher(["idiot"], [], 5)
    words = ["idiot" if i % 7 == 0 or 100 < i < 130 else "x" for i in range(400)]
    places = [i for i, w in enumerate(words) if w == "idiot"]
    want = max(sum(1 for q in places if p <= q < p + 50) for p in places)
    assert np.expm1(features(" ".join(words), matcher, 50)[5]) == np.float64(want).round(9) or abs(
        np.expm1(features(" ".join(words), matcher, 50)[5]) - want) < 1e-9


def test_one_repeated_labelled_id_is_bounded(spark, docs):
    rows = [(i, "you idiot moron" if i % 2 else "a kind word") for i in range(100)] + [(1, "you idiot moron")] * 5_000
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id bigint, toxic int")
    got = toxicity(docs(rows), labels, max_labelled=300)
    assert got.count() == len(rows)
    assert got.where(F.col("predicted") == F.col("doc_id") % 2).count() > 0.9 * len(rows)


def test_a_language_without_ids_is_learned(docs):
    one = ["alpha beta gamma delta words here", "beta gamma alpha here"]
    two = ["zwölf boxkämpfer jagen viktor quer", "über den sylter deich quer"]
    rows = [(i, one[i % 2] + f" {i}", "aa") for i in range(60)] + [(None, two[i % 2] + f" {i}", "bb") for i in range(60)]
    got = language_id(docs(rows), sample_per_lang=10).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in got} == {"aa": 60, "bb": 60}


def test_a_chain_of_ascending_ids_takes_few_rounds(spark, monkeypatch):
    rounds = []

    def cut(df, name, *by):
        if name == "links":
            rounds.append(name)
        return real(df, name, *by)
    real = C.cut
    monkeypatch.setattr(C, "cut", cut)
    links = spark.range(2_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = C.components(links.union(spark.sql("select 5000L a, 4000L b")))
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {0: 2_001, 4000: 2}
    assert len(rounds) - 1 <= 20


@pytest.mark.parametrize("uri, want", [
    ("/shared/x", "/shared/x"), ("file:/shared/x", "file:/shared/x"), ("hdfs://nn:8020/x", "hdfs://nn:8020/x"),
    ("s3a://bucket/x", "s3://bucket/x"), ("gs://bucket/x", "gs://bucket/x"), ("dbfs:/x/y", "file:///dbfs/x/y"),
    ("wasbs://c@acc.blob.core.windows.net/x", "abfss://c@acc.dfs.core.windows.net/x"),
    ("abfss://c@acc.dfs.core.windows.net/x", "abfss://c@acc.dfs.core.windows.net/x")])
def test_stores_are_named_as_arrow_names_them(uri, want):
    assert arrow_uri(uri) == want


def test_a_store_without_a_file_system_is_refused():
    with pytest.raises(ValueError, match="oss"):
        arrow_uri("oss://bucket/x")


def test_a_private_index_is_gone_after_use(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup(docs([(1, "a  b"), (2, "a b")])).where("kept").count() == 1
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_compacted_index_holds_the_same_digests(spark, docs):
    name = f"digest_compact_{time.time_ns()}"
    index = DigestIndex(spark, name, path=scratch(spark, name), buckets=2)
    for k in range(3):
        exact_dedup(docs([(10 * k + i, f"text {10 * k + i}") for i in range(10)]), index)
    files = len(index.read().inputFiles())
    index.compact()
    assert len(index.read().inputFiles()) <= 2 < files
    again = {r.doc_id: r.keep_id for r in exact_dedup(docs([(99, "text 7"), (98, "new")]), index).collect()}
    assert again == {99: 7, 98: 98} and index.read().count() == 31
    index.drop()
    assert not spark.catalog.tableExists(name)
