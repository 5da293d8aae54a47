"""The learned operators as a whole against plain versions of their rules, and the pipeline's edge rows."""
import math
import random
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrosight.llm.langid import DIMS, language_id
from hydrosight.llm.quality import BINS, quality
from hydrosight.llm.quality import features as quality_features
from hydrosight.llm.toxicity import REPORTING, toxicity
from test_classifiers import distance


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


# --- quality -------------------------------------------------------------------------------------------

def brute_strength(groups, prior):
    groups = [(n, t) for n, t in groups if n > 0]
    if len(groups) < 2:
        return 1000.0
    within = prior * (1 - prior)
    spread = sum(n * (t / n - prior) ** 2 for n, t in groups)
    between = (spread - (len(groups) - 1) * within) / sum(n for n, _ in groups)
    if between >= within:
        return 2.0
    return min(1000.0, max(2.0, within / between)) if between > 0 else 1000.0


def brute_quality(rows, labels):
    """Scores of (id, text, path, host) rows, by position."""
    found = [[bisect_left(e, v) for e, v in zip(BINS.values(), quality_features((r[1] or "").encode()))] for r in rows]
    marks = defaultdict(list)
    for i, q in labels:
        if i is not None and q is not None:
            marks[i].append(int(q == 1))
    train = [k for k, r in enumerate(rows) if not held(r[0]) and r[0] in marks]
    good = sum(sum(marks[rows[k][0]]) for k in train)
    bad = sum(len(marks[rows[k][0]]) for k in train) - good
    logit = lambda x: math.log(x) - math.log(1 - x)
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def evidence(bins):
        total = 0.0
        for f, ends in enumerate(BINS.values()):
            here = [marks[rows[k][0]] for k in train if found[k][f] == bins[f]]
            g, n = sum(map(sum, here)), sum(map(len, here))
            total += math.log((g + .5) / (good + .5 * (len(ends) + 1))) - math.log((n - g + .5) / (bad + .5 * (len(ends) + 1)))
        return total
    e = [evidence(b) for b in found]
    site = [(r[3] or "", r[2] or "") for r in rows]
    paths = defaultdict(lambda: [0, 0.0])
    for k in range(len(rows)):
        p = sigmoid(e[k] + logit(good / (good + bad)))
        paths[site[k]][0] += 1
        paths[site[k]][1] += np.mean(marks[rows[k][0]]) if k in train else p
    hosts = defaultdict(lambda: [0, 0.0])
    for (h, _), (n, t) in paths.items():
        hosts[h][0] += n
        hosts[h][1] += t
    rate = sum(t for _, t in hosts.values()) / len(rows)
    a, b = brute_strength(hosts.values(), rate), brute_strength(paths.values(), rate)
    host = {h: (t + a * rate) / (n + a) for h, (n, t) in hosts.items()}
    path = {s: (t + b * host[s[0]]) / (n + b) for s, (n, t) in paths.items()}
    return [sigmoid(e[k] + logit(path[site[k]])) for k in range(len(rows))]


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(240):
        host = rng.choice(["a", "a", "a", "b", "c", None])
        good = rng.random() < {"a": .8, "b": .4}.get(host, .5)
        words = [rng.choice(["plain", "Words", "of", "a", "7", "längere"]) if good or rng.random() < .5 else rng.choice(["$$", "###", "AB", "%"])
                 for _ in range(rng.randint(0, 30))]
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), host))
        if rng.random() < .7:
            labels.append((i, int(good)))
    rows += [rows[3], rows[3], (None, "of a", "en", "a"), (500, None, "en", "z"), (501, "plain words " * 9000, "fr", "z")]
    labels += [(5, 0), (5, 1), (None, 0), (6, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, doc_id bigint, text string, lang string, source string")
    got = quality(df, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    want = brute_quality(rows, labels)
    assert len(got) == len(rows) and all(r.kept == (r.score >= 0.1) for r in got)
    assert [r.score for r in sorted(got, key=lambda r: r.k)] == pytest.approx(want, abs=1e-9)


# --- language ------------------------------------------------------------------------------------------

def trigrams(text):
    low = "".join(c if c.isalnum() and not c.isdecimal() and c.isalpha() else " " for c in text.lower())
    b = (" " + re.sub(" +", " ", low) + " ").encode()
    out = np.zeros(DIMS)
    for x, y, z in zip(b, b[1:], b[2:]):
        out[((x << 16 | y << 8 | z) * 2654435761 % (1 << 32)) >> 20] += 1
    return out


def test_language_with_one_centroid_brute_force(docs):
    rng, rows = random.Random(4), []
    words = {"aa": "das ist der hund und die katze über straße".split(), "bb": "the cat and a dog over there street".split(),
             "cc": "le chat et un chien dans la rue déjà".split()}
    for i in range(150):
        lang = rng.choice(list(words))
        mixed = words[lang] * 3 + words[rng.choice(list(words))]
        rows.append((i, " ".join(rng.choice(mixed) for _ in range(rng.randint(1, 12))) + rng.choice(["", ".", " 12"]),
                     lang if rng.random() < .9 else None))
    rows += [(200, "the dog " * 3000, None), (201, "зима", None), (202, "42 !", "aa"), (203, None, "aa"), (None, "le chien", "cc")]
    train = [(t, lang) for i, t, lang in rows if lang and not held(i) and t and any(unicodedata.category(c)[0] == "L" for c in t)]
    seen = sum((trigrams(t) > 0).astype(int) for t, _ in train)
    idf = np.log((len(train) + 1) / (seen + 1)) + 1
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    vector = lambda t: unit(np.sqrt(trigrams(t)) * idf)
    langs, centre, limit = sorted(words), {}, {}
    for lang in langs:
        own = [vector(t) for t, x in train if x == lang]
        centre[lang] = unit(np.mean(own, axis=0))
        cosines = [v @ centre[lang] for v in own]
        limit[lang] = np.mean(cosines) - 4 * np.std(cosines) - 0.02
    got = {r.doc_id: r for r in language_id(docs(rows), clusters=1).collect()}
    for i, text, _ in rows:
        if text is None or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0, True)
            continue
        cosine = {x: vector(text) @ centre[x] for x in langs}
        best = max(langs, key=cosine.get)
        second = sorted(cosine.values())[-2]
        assert got[i].cosine == pytest.approx(cosine[best], abs=1e-4)
        assert got[i].score == pytest.approx(1 / sum(math.exp(25 * (c - cosine[best])) for c in cosine.values()), abs=5e-3)
        if cosine[best] - second > 1e-4:
            assert got[i].lang_pred == best
            if abs(cosine[best] - limit[best]) > 1e-4:
                assert got[i].rejected == (cosine[best] < limit[best])


def test_language_ties_go_to_the_first_name(docs):
    rows = [(i, "one and the same text", "bb" if i % 2 else "aa") for i in range(40)]
    got = language_id(docs(rows)).collect()
    assert {r.lang_pred for r in got} == {"aa"} and all(abs(r.score - 0.5) < 1e-6 for r in got)


# --- toxicity ------------------------------------------------------------------------------------------

def brute_features(segments, lexicon, stems):
    """Of (words, quoted) segments. Matches are least distances over all terms and prefixes."""
    def edits(w):
        found = [d for t in lexicon for d in [distance(w, t)] if d <= (len(t) >= 5)]
        found += [d for s in stems for n in range(len(w) + 1) for d in [distance(w[:n], s)] if d <= (len(s) >= 5)]
        return min(found, default=None)
    words = [(w, q) for part, q in segments for w in part]
    hits = [(i, w, e, q) for i, (w, q) in enumerate(words) for e in [edits(w)] if e is not None]
    told = lambda i: any(w in REPORTING and abs(i - j) <= 3 for j, (w, _) in enumerate(words))
    used = [(i, w, e) for i, w, e, q in hits if not q and not told(i)]
    exact = [w for _, w, e in used if e == 0]
    window = max((sum(1 for j, *_ in used if i <= j < i + 50) for i, *_ in used), default=0)
    if not hits:
        return [0.0] * 6
    return [math.log1p(x) for x in (len(exact), len(used) - len(exact), len(hits) - len(used), len(set(exact)),
                                    1000 * len(exact) / len(words), window)]


def test_toxicity_brute_force(spark):
    rng = random.Random(9)
    calm = ["".join(rng.choice("aeiourlnt") for _ in range(rng.randint(2, 7))) for _ in range(40)] + ["said", "word"]
    rows, labels = [], []
    for i in range(260):
        toxic, parts = i % 4 == 0, []
        for _ in range(rng.randint(1, 4)):
            words = [rng.choice(calm) for _ in range(rng.randint(1, 25))]
            if toxic or rng.random() < .003:
                t = rng.choice(["zgkbot", "zgkbots", "pwvm", "xqdhsy"])
                words.insert(rng.randrange(len(words) + 1), t if rng.random() < .8 else t[:2] + t[3:])
            parts.append((words, rng.random() < .15))
        rows.append((i, parts))
        labels.append((i, int(toxic)))
    text = lambda parts: " . ".join(f'"{" ".join(w)}"' if q else " ".join(w) for w, q in parts)
    labels += [(3, None)]
    train = [(parts, lab) for i, parts in rows if not held(i) for j, lab in labels if j == i and lab is not None]
    seen, bad = Counter(), Counter()
    for parts, lab in train:
        words = {w for part, _ in parts for w in part}
        keys = {(w, 0) for w in words} | {(w[:n], 1) for w in words for n in (4, 5, 6) if len(w) >= n}
        seen.update(keys)
        bad.update(keys if lab else ())
    toxic = sum(lab for _, lab in train)
    strong = [k for k in seen if bad[k] >= max(4, 0.008 * toxic) and
              math.log((bad[k] + .5) / (toxic + 1)) - math.log((seen[k] - bad[k] + .5) / (len(train) - toxic + 1)) >= 3.5]
    lexicon = [w for w, kind in strong if kind == 0]
    every = [w for w, kind in strong if kind == 1]
    stems = [w for w in every if not any(w != s and w.startswith(s) for s in every)]
    assert lexicon and stems
    x = np.array([[1.0, *brute_features(parts, lexicon, stems)] for parts, _ in train])
    y = np.array([lab for _, lab in train], float)
    weights, damp = np.zeros(7), np.diag([1e-6] + [1.0] * 6)
    for _ in range(60):  # the penalised likelihood's summit
        p = 1 / (1 + np.exp(-x @ weights))
        weights -= np.linalg.lstsq(x.T @ (x * (p * (1 - p))[:, None]) + damp, x.T @ (p - y) + damp @ weights, rcond=None)[0]
    df = spark.createDataFrame([(i, text(parts)) for i, parts in rows], "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity(df, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    for i, parts in rows:
        f = brute_features(parts, lexicon, stems)
        assert [got[i].n_exact, got[i].n_fuzzy, got[i].n_quoted] == [round(math.expm1(v)) for v in f[:3]], text(parts)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(weights[0] + np.dot(weights[1:], f)))), abs=1e-6)


# --- the pipeline --------------------------------------------------------------------------------------

def test_pipeline_edge_rows(spark, docs, real, tmp_path):
    """Null ids and texts, repeated rows, a long text, and columns named as the operators' own."""
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in real[0].orderBy("doc_id").limit(150).collect()]
    rows += [rows[5], rows[5], (None, rows[7][1], "en", "src1"), (None, None, None, None), (10 ** 6, None, "en", None),
             (10 ** 6 + 1, "", "de", "src2"), (10 ** 6 + 2, " ".join(f"word{i % 5000}x" for i in range(120_000)), "en", "src1")]
    clash = ["score", "kept", "epoch", "tokens", "take", "n_lines", "n_dropped", "host", "__mplan", "row"]
    df = docs(rows).select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in clash))
    out = df
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, out, "/root/testdata/sf0.01").write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.dtypes == df.dtypes and out.count() > 100
            wrong = F.lit(False)
            for c in clash:
                wrong |= ~F.col(c).eqNullSafe(F.concat(F.lit(c), F.col("doc_id").cast("string")))
            assert out.where(wrong).count() == 0
            if name == "near-copies":
                assert out.where("doc_id = 1000002").first().text.count(" ") == 119_999
            if name == "mixing":  # the end of a prefix may lie in it
                words = sum(len(r.text.split()) for r in out.where("doc_id = 1000002").collect())
                assert words > 1_000
    assert out.where("doc_id = 1000002").agg(F.sum("length")).first()[0] > words
