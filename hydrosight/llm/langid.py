"""Language identification by the nearest of several centroids per language.

Texts are lower-cased and all but letters becomes spaces; their UTF-8 byte trigrams
are hashed to ``DIMS`` counts, damped by the square root, weighted by inverse document frequency over all training texts and
scaled to unit length. A spherical k-means on a bounded sample of each
language (``sample_per_lang`` texts at most, the first by a hash of id and text; the only sample)
gives ``clusters`` centroids. A text takes the language of the centroid with the largest
cosine; it is rejected when that cosine lies below the centroid's reach, the
mean of its members less ``reach`` standard deviations. The score is the share
of the best language in a softmax over the languages' best cosines.

The model (languages x clusters vectors) is bounded; languages are few by nature.

Defined cases
    null text, no letter   ``und``, score 0, rejected
    null lang              never learned from
    null doc_id            the fold of the empty text
    rejected texts         keep the nearest language unless ``reject_as_und``
    ties                   the first language by name
    nothing to learn from  ``und`` for all, score 0, rejected
    repeated rows          each row is learned from and predicted
    very long text         taken whole, a block at a time
    empty table            empty result
    clashing columns       only the id, text and lang columns are read
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrosight.llm.common import bound_batches, held_out

DIMS = 4096
BLOCK = 1 << 20
_GAP = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """Hashed byte-trigram counts of a whole text."""
    b = np.frombuffer(f" {_GAP.sub(' ', text.lower())} ".encode(), np.uint8)
    out = np.zeros(DIMS, np.int64)
    for a in range(0, len(b) - 2, BLOCK):
        x = b[a:a + BLOCK + 2].astype(np.uint32)
        code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
    return out


def _vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(np.array([counts(t) for t in texts]).reshape(-1, DIMS)) * idf
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _document_frequencies(batches):
    seen, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for t in batch.column(0).to_pylist():
            seen += counts(t) > 0
            n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS), pa.int32()),
                                          pa.array(np.append(n, seen), pa.int64())], names=["bin", "n"])


def _sampled(idf: np.ndarray):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 256):
                v = _vectors(texts[a:a + 256], idf)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, 256), pa.array([x.tobytes() for x in v], pa.binary())],
                    names=["lang", "v"])
    return run


def _kmeans(clusters: int, rounds: int, reach: float):
    def run(key, group):
        x = np.array([np.frombuffer(v, np.float32) for v in group.column("v").to_pylist()])
        x = x[np.lexsort(x[:, :8].T)]  # the same start whatever the order of rows
        centre = x.mean(axis=0, keepdims=True)
        while len(centre) < min(clusters, len(x)):  # farthest first
            centre = np.vstack([centre, x[np.argmin((x @ centre.T).max(axis=1))]])
        for _ in range(rounds):
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
            own = np.argmax(x @ centre.T, axis=1)
            for c in range(len(centre)):
                if (own == c).any():
                    centre[c] = x[own == c].mean(axis=0)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        own, cosine = np.argmax(x @ centre.T, axis=1), (x @ centre.T).max(axis=1)
        used = [c for c in range(len(centre)) if (own == c).any()]
        return pa.table({
            "lang": [key[0].as_py()] * len(used),
            "centroid": pa.array([centre[c].astype(np.float32).tobytes() for c in used], pa.binary()),
            "reach": pa.array([float(cosine[own == c].mean() - reach * cosine[own == c].std() - 0.02)
                               for c in used], pa.float64())})
    return run


def _predict(idf: np.ndarray, langs: list[str], centroids: np.ndarray, reach: np.ndarray,
             of: np.ndarray, sharpness: float, reject_as_und: bool):
    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a in range(0, max(1, len(texts)), 256):
                part = texts[a:a + 256]
                if not part:
                    continue
                lang, score, cosine = ["und"] * len(part), np.zeros(len(part)), np.zeros(len(part))
                rejected = np.ones(len(part), bool)
                at = [i for i, t in enumerate(part) if t and _LETTER.search(t)]
                if at and langs:
                    sims = (_vectors([part[i] for i in at], idf) @ centroids.T).astype(np.float64)
                    best = np.array([sims[:, of == k].max(axis=1) for k in range(len(langs))]).T
                    e = np.exp(sharpness * (best - best.max(axis=1, keepdims=True)))
                    near = sims.argmax(axis=1)
                    for j, i in enumerate(at):
                        score[i], cosine[i] = e[j].max() / e[j].sum(), sims[j, near[j]]
                        rejected[i] = cosine[i] < reach[near[j]]
                        if not (reject_as_und and rejected[i]):
                            lang[i] = langs[of[near[j]]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, 256), batch.column(1).slice(a, 256),
                     pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                     pa.array(np.clip(cosine, 0, 1), pa.float64()), pa.array(rejected)],
                    names=["doc_id", "held_out", "lang_pred", "score", "cosine", "rejected"])
    return run


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                clusters: int = 4, sample_per_lang: int = 500, reach: float = 4.0,
                sharpness: float = 25.0, reject_as_und: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, cosine, rejected."""
    bound_batches(df.sparkSession)
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    fold = held_out(F.col(id_col))
    train = df.where(lang.isNotNull() & text.rlike(r"\p{L}") & ~fold)
    stats = {r["bin"]: r["n"] for r in train.select(text.alias("text"))
             .mapInArrow(_document_frequencies, "bin int, n bigint")
             .groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    n = stats.get(-1, 0)
    idf = np.log((n + 1) / (np.array([stats.get(i, 0) for i in range(DIMS)]) + 1)) + 1.0
    langs: list[str] = []
    of, centroids, limits = np.zeros(0, np.int64), np.zeros((0, DIMS), np.float32), np.zeros(0)
    if n:
        # by id and text, so that rows of one id (or none) are not in or out together; copies count
        # once, and about three times the bound is drawn before the first ones are ranked
        draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text, F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
        drawn = train.select(lang.alias("lang"), text.alias("text"), draw.alias("draw"))
        sizes = drawn.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()
        size = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], float(r["n"]))])
        few = drawn.where(F.col("draw") * size[F.col("lang")] < 3 * sample_per_lang).dropDuplicates(["lang", "draw"])
        place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
        sample = few.withColumn("place", place).where(F.col("place") <= sample_per_lang).select("lang", "text")
        found = (sample.mapInArrow(_sampled(idf), "lang string, v binary").groupBy("lang")
                 .applyInArrow(_kmeans(clusters, 12, reach), "lang string, centroid binary, reach double")
                 .collect())
        found.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
        langs = sorted({r["lang"] for r in found})
        of = np.array([langs.index(r["lang"]) for r in found], np.int64)
        centroids = np.array([np.frombuffer(r["centroid"], np.float32) for r in found]).reshape(-1, DIMS)
        limits = np.array([r["reach"] for r in found])
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), fold.alias("held_out"),
                     text.alias("text")).mapInArrow(
        _predict(idf, langs, centroids, limits, of, sharpness, reject_as_und),
        "doc_id bigint, held_out boolean, lang_pred string, score double, cosine double, rejected boolean")
