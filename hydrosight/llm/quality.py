"""Quality classification with hierarchical empirical Bayes.

Evidence of the text: shares of symbols, capitals and digits, word length,
distinct words and repeats are cut into bins; from the labelled training rows a
grouped count gives each bin's log likelihood ratio (naive Bayes). Evidence of
the site: for each host, and each path in it, the mean over all documents of the label
(of the training fold's documents that have one) or else the classifier's probability. ``documents``
has no URL: the columns ``source`` and ``lang`` stand for host and path.
Host means shrink to the global rate and path means to their host's posterior,
each by a weight in documents (``strength``) that the spread between the groups sets (method
of moments), so a site with few documents keeps to the prior above it.
The score is the classifier's log odds with the path posterior as its prior.

Features are counted over whole texts by array operations, characters by their Unicode
category and words in lower case, all else is DataFrame expressions. The tables of bins are bounded
by features x bins; the path posteriors are joined, which Spark broadcasts only under its own
threshold and otherwise shuffles with skew splitting. Labels are joined by shuffle.

Defined cases
    null or empty text   all shares 0, the bins of an empty text
    very long text       counted whole
    null host or path    a site of its own (the empty name)
    null label           not learned from
    null doc_id          the fold of the empty text; matches no label
    repeated rows        each is counted and scored
    no labels, or of one class only   every score is 0.5, everything is kept
    empty table          empty result
    clashing columns     internal columns live in structs named ``__q*``; score
                         and kept of the input are replaced
"""

from __future__ import annotations

import math
import sys
import unicodedata
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrosight.llm.common import bound_batches, cut, held_out
from hydrosight.llm.jaccard import word_hashes

#: upper ends of each feature's bins
BINS = {
    "symbols": (0.001, 0.005, 0.01, 0.02, 0.04, 0.07, 0.11, 0.16, 0.25, 0.4),
    "capitals": (0.005, 0.02, 0.04, 0.06, 0.1, 0.2, 0.35, 0.6, 0.85),
    "digits": (0.0005, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4),
    "word_length": (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 9.0, 12.0, 20.0),
    "words": (1.0, 5.0, 20.0, 60.0, 200.0, 1000.0, 5000.0),
    # distinct words against what a text of that length has: words ^ 0.8
    "distinct": (0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 1.2, 1.6, 2.2),
}


_OTHER, _LOWER, _UPPER, _DIGIT, _NUMBER, _BLANK, _POINT, _WIDE = range(8)
#: what each byte of ASCII counts as; the bytes of other characters are _WIDE
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = _LOWER, _UPPER, _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = _POINT
_CLASS[128:] = _WIDE


@lru_cache(maxsize=1)
def _code_points() -> np.ndarray:
    """The class of each code point by its Unicode category: Lu a capital, other L a
    letter, N a number (neither digit nor symbol), all else outside ASCII a symbol."""
    kinds = {"Lu": _UPPER, "Ll": _LOWER, "Lt": _LOWER, "Lm": _LOWER, "Lo": _LOWER,
             "Nd": _NUMBER, "Nl": _NUMBER, "No": _NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i)), _OTHER) for i in range(sys.maxunicode + 1)),
                      np.uint8, sys.maxunicode + 1)
    out[:128] = _CLASS[:128]
    return out


def features(text: bytes | None) -> tuple[float, ...]:
    """The features of a whole text, in the order of ``BINS``."""
    text = text or b""
    n, size = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8), len(text)
    if n[_WIDE]:
        whole = text.decode("utf-8", "replace")
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        n, size = np.bincount(_code_points()[points], minlength=8), len(points)
        text = whole.lower().encode()
    size = max(1, size)
    letters = int(n[_LOWER] + n[_UPPER])
    words = word_hashes(text)  # A-Z as a-z
    words.sort()
    distinct = int((words[1:] != words[:-1]).sum()) + 1 if len(words) else 0
    return (n[_OTHER] / size, n[_UPPER] / max(letters, 1), n[_DIGIT] / size, letters / max(len(words), 1),
            float(len(words)), distinct / max(len(words), 1) ** 0.8)


def bins(text: Column) -> Column:
    """The bin of each feature, as an array in the order of ``BINS``."""
    def run(texts: pa.Array) -> pa.Array:
        found = [[bisect_left(ends, v) for ends, v in zip(BINS.values(), features(t))] for t in texts.to_pylist()]
        return pa.array(found, pa.list_(pa.int32()))
    return F.arrow_udf(run, "array<int>")(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def _site(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def _strength(groups: DataFrame, prior: float, least: float = 2.0, most: float = 1000.0) -> float:
    """Documents' worth of prior by the method of moments: ``groups`` has n and
    total; between-group variance against what chance alone would give."""
    r = groups.where("n > 0").agg(
        F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - F.lit(prior), F.lit(2.0))).alias("ss")).first()
    if not r["g"] or r["g"] < 2:
        return most
    within = prior * (1 - prior)
    between = (r["ss"] - (r["g"] - 1) * within) / r["n"]
    return least if between >= within else min(most, max(least, within / between if between > 0 else most))


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            host: str = "source", path: str = "lang", label_col: str = "quality",
            threshold: float = 0.1) -> DataFrame:
    """The input's columns, then score (0 to 1, higher: better) and kept. Below the
    default threshold bad is nine times likelier than good: a clean document that
    goes costs more than a bad one that stays."""
    bound_batches(df.sparkSession)
    doc = F.col(id_col).cast("bigint")
    fold = held_out(F.col(id_col))
    small = cut(df.select(doc.alias("id"), fold.alias("held_out"), _site(F.col(host)).alias("host"),
                          _site(F.col(path)).alias("path"), bins(F.col(text_col)).alias("bins")), "quality-bins")
    marked = labels.where(F.col(label_col).isNotNull()).select(
        doc.alias("id"), (F.col(label_col) == 1).cast("int").alias("label")).groupBy("id").agg(
        F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
    # labels grow with the corpus: never broadcast
    train = cut(small.where(~F.col("held_out")).select("id", "host", "path", "bins").join(marked.hint("merge"), "id")
                .select("host", "path", "good", "n", "bins"), "quality-train")
    r = train.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    good = r["good"] or 0
    bad = (r["n"] or 0) - good
    own = [c for c in df.columns if c not in ("score", "kept")]
    if not (bad and good):
        return df.select(*own, F.lit(0.5).alias("score"), F.lit(True).alias("kept"))
    counts = {(r["feature"], r["bin"]): (r["good"], r["n"]) for r in
              train.select("good", "n", F.posexplode("bins").alias("feature", "bin"))
              .groupBy("feature", "bin").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect()}
    ratios = []  # by feature: the log likelihood ratio of each bin
    for f, ends in enumerate(BINS.values()):
        k, row = len(ends) + 1, []
        for b in range(k):
            g, a = counts.get((f, b), (0, 0))
            row.append(math.log((g + 0.5) / (good + 0.5 * k)) - math.log((a - g + 0.5) / (bad + 0.5 * k)))
        ratios.append(row)

    def evidence(b: Column) -> Column:
        return sum((F.array(*(F.lit(x) for x in row))[b[f]] for f, row in enumerate(ratios)), F.lit(0.0))

    def sigmoid(x: Column) -> Column:
        return 1 / (1 + F.exp(-x))

    rate = good / (good + bad)
    prior = math.log(rate) - math.log(1 - rate)
    p = sigmoid(evidence(F.col("bins")) + F.lit(prior))
    # a labelled training row puts its label (the mean of several) in the place of its probability
    soft = small.select("host", "path", F.lit(1).alias("one"), p.alias("p")).unionAll(
        train.select("host", "path", F.lit(0).alias("one"), (F.col("good") / F.col("n") - p).alias("p")))
    paths = cut(soft.groupBy("host", "path").agg(F.sum("one").alias("n"), F.greatest(F.sum("p"), F.lit(0.0)).alias("total")),
                "quality-paths")
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "quality-hosts")
    rate = hosts.agg(F.sum("total") / F.sum("n")).first()[0]
    if rate is None:
        rate = 0.5
    a, b = _strength(hosts, rate), _strength(paths, rate)
    host_rate = hosts.select("host", ((F.col("total") + a * rate) / (F.col("n") + a)).alias("host_rate"))
    posterior = cut(paths.join(host_rate, "host").select(
        F.struct("host", "path").alias("__qsite"),
        ((F.col("total") + b * F.col("host_rate")) / (F.col("n") + b)).alias("__qrate")), "quality-posterior")
    rated = df.select(*own, F.struct(_site(F.col(host)).alias("host"), _site(F.col(path)).alias("path"))
                      .alias("__qsite"), bins(F.col(text_col)).alias("__qbins"))
    rated = rated.join(posterior, "__qsite")
    kept_rate = F.least(F.greatest(F.col("__qrate"), F.lit(1e-6)), F.lit(1 - 1e-6))
    score = sigmoid(evidence(F.col("__qbins")) + _logit(kept_rate))
    return rated.select(*own, score.alias("score")).withColumn("kept", F.col("score") >= threshold)
