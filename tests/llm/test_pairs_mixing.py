"""Jaccard join, embedding join, components, mixing and the pipeline against brute force."""
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from hydrosight.llm import jaccard
from hydrosight.llm.components import components
from hydrosight.llm.embed_join import near_duplicates
from hydrosight.llm.mixing import mix, prefix


def groups(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(60)] + [(500, 500)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    want = groups({x for e in edges for x in e}, edges)
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- Jaccard ---------------------------------------------------------------------------------------

def brute_shingles(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(low))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_jaccard(rows, percent=75):
    sets = [brute_shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    up = groups(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[up[k]] = min(least.get(up[k], i), i)
    return sorted(((i, len(s), least.get(up[k]) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def near_copies(seed=0):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for size in (1, 2, 5, 6, 7, 8, 9, 12, 20, 40, 80, 150, 400):
        for _ in range(4):
            base = [rng.choice(vocab) for _ in range(size)]
            if rng.random() < 0.5:
                base[size // 2:size // 2] = passage
            for _ in range(5):
                w = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 3, size // 40])):
                    w[rng.randrange(len(w))] = rng.choice(vocab)
                if rng.random() < 0.2:
                    del w[-1:]
                rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.1 else "  ".join(w)))
    base = [rng.choice(vocab) for _ in range(200)]
    for _ in range(40):  # a long chain: each a little further away
        base = list(base)
        base[rng.randrange(len(base))] = rng.choice(vocab)
        rows.append((len(rows), "\n".join(base)))
    rows += [(9001, None), (9002, ""), (9003, " \t\n"), (None, rows[30][1]), (5, rows[5][1]), (None, "only here"),
             (9004, "a " * 60_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, short, salted", [(0, 8, 16), (1, 2, 0)])
def test_jaccard_brute_force(docs, seed, short, salted, monkeypatch):
    # the second case sends all but pairs through the long-list turns
    monkeypatch.setattr(jaccard, "SHORT", short)
    rows = near_copies(seed)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(rows)).collect()), key=str)
    assert got == brute_jaccard(rows)


@pytest.mark.parametrize("percent", [51, 60, 66, 67])
def test_jaccard_brute_force_of_small_sets(docs, percent):
    rows = [(i, " ".join("abcdefghijkl"[a:a + n])) for i, (a, n) in
            enumerate((a, n) for n in (3, 5, 6, 7, 8, 9) for a in (0, 1, 3))]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in
                  jaccard.jaccard_components(docs(rows), percent=percent).collect()), key=str)
    assert got == brute_jaccard(rows, percent)


@pytest.mark.parametrize("percent", [0, 50, 101])
def test_jaccard_refuses_percents_that_it_is_not_exact_at(docs, percent):
    with pytest.raises(ValueError):
        jaccard.jaccard_components(docs([(1, "a b")]), percent=percent)


def test_jaccard_empty_and_clashing(docs):
    assert jaccard.jaccard_components(docs([])).count() == 0
    df = docs([(2, "a b c d e f"), (1, "A b c d e f")]).withColumn("sid", F.lit(1)).withColumn("n", F.lit("n"))
    assert {r.component_id for r in jaccard.jaccard_components(df).collect()} == {1}


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 300), min_size=1, max_size=60), st.sets(st.integers(0, 300), min_size=1, max_size=60),
       st.sets(st.integers(0, 300), max_size=60))
def test_bitmaps_never_drop_a_link(x, y, common):
    x, y = x | common, y | common
    mix64 = lambda s: np.unique(np.array([int.from_bytes(hashlib.md5(b"%d" % v).digest()[:8], "little") for v in s], np.uint64))
    a, b = mix64(x), mix64(y)
    if 100 * len(x & y) >= 75 * len(x | y):
        assert jaccard.may_link(jaccard.bitmap(a), len(a), jaccard.bitmap(b), len(b), 75)
        differ = sum((p ^ q).bit_count() if p ^ q >= 0 else ((p ^ q) + (1 << 64)).bit_count()
                     for p, q in zip(jaccard.folded(a), jaccard.folded(b)))
        assert (len(a) + len(b) - differ) * 175 >= (len(a) + len(b)) * 150


@pytest.mark.parametrize("light", [2, 4, 7, 12, 30, 64])
def test_linked_sets_share_a_key(light):
    """Whatever the boundary and the order, two sets that link share a list."""
    rng, linked = random.Random(light), 0
    universe = [int.from_bytes(hashlib.md5(b"%d" % v).digest()[:8], "little") for v in range(300)]
    frequent = np.zeros(1 << jaccard.COUNTERS, np.uint8)
    frequent[[h >> (64 - jaccard.COUNTERS) for h in rng.sample(universe, 60)]] = 3
    for _ in range(600):
        n = rng.randint(3, 90)
        x = set(rng.sample(universe, n))
        y = set(rng.sample(sorted(x), n - rng.randint(0, n // 4)))
        y |= set(rng.sample(sorted(set(universe) - x), rng.randint(0, n // 5)))
        if len(x & y) * 100 < 75 * len(x | y) or x == y:
            continue
        lists = []
        for s in (x, y):
            single, _, pos, pairs = jaccard._keys(np.unique(np.array(sorted(s), np.uint64)), frequent, light, 75)
            lists.append({("s", int(k)): int(i) for k, i in zip(single, pos)} | {("p", int(k)): 0 for k in pairs})
        common = set(lists[0]) & set(lists[1])
        assert any(jaccard.may_overlap(len(x), lists[0][k], len(y), lists[1][k], 75) for k in common)
        linked += 1
    assert linked > 100


def test_boundary_follows_the_cost():
    assert jaccard.boundary({10: 100, 50: 100}, 0.0, 75) < jaccard.boundary({10: 100, 50: 100}, 16.0, 75)


# --- embeddings --------------------------------------------------------------------------------------

def brute_vectors(rows, t=0.9):
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for _, v in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                    links.append((i, j))
    up = groups(range(len(rows)), links)
    n, least = np.bincount(np.array(links, int).ravel(), minlength=len(rows)), {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[up[k]] = min(least.get(up[k], i), i)
    comp = [least.get(up[k]) if ok[k] else i for k, (i, _) in enumerate(rows)]
    return sorted(((i, int(n[k]), comp[k], i == comp[k]) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_duplicates_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(60):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 6))):
            rows.append((len(rows), (base + rng.normal(size=16) * rng.choice([0.0, 0.2, 0.35])).astype("f4").tolist()))
    v = rows[0][1]
    rows += [(700 + k, v) for k in range(50)] + [(800, None), (801, []), (802, [0.0] * 16), (803, [float("nan")] * 16),
             (804, [1.0, None] * 8), (805, [float("inf")] * 16), (806, [3 * x for x in v]), (None, v), (807, v[:8]),
             (807, v[:8]), (808, [1e30 * x for x in v]), (None, [1.0] * 3)]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumn("key", F.lit(1))
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) if kind == "float" else x for x in v])
             for i, v in rows]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(df, block=32).collect()), key=str)
    assert got == brute_vectors(exact)


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert near_duplicates(df).count() == 0
    only = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id bigint, embedding array<float>")
    assert sorted((r.vec_id, r.n_links, r.kept) for r in near_duplicates(only).collect()) == [(1, 0, True), (2, 0, True)]


# --- mixing --------------------------------------------------------------------------------------------

def brute_mix(rows, weights, share, epochs, seed):
    words = {}
    leaves = {}
    for k, (i, text, lang, source) in enumerate(rows):
        words[k] = len(re.findall("[^\x20\x09-\x0D]+", text or ""))
        leaves.setdefault((lang or "", source or ""), []).append(k)
    supply = {leaf: epochs * sum(words[k] for k in ks) for leaf, ks in leaves.items()}

    def pour(children, budget):  # {child: (weight, supply)} -> {child: budget}, raising the level step by step
        out, open_ = {}, {c: x for c, x in children.items() if x[0] > 0}
        while open_:
            total = sum(w for w, _ in open_.values())
            full = {c for c, (w, s) in open_.items() if s * total <= w * budget}
            if not full:
                return out | {c: w * budget // total for c, (w, _) in open_.items()}
            for c in full:
                out[c] = open_.pop(c)[1]
                budget -= out[c]
        return out
    budget = sum(words.values()) * share[0] // share[1]
    langs = {}
    for (lang, _), s in supply.items():
        langs[lang] = langs.get(lang, 0) + s
    out = []
    for lang, b in pour({x: (weights["lang"].get(x, 1), s) for x, s in langs.items()}, budget).items():
        mine = {leaf: (weights["source"].get(leaf[1], 1), s) for leaf, s in supply.items() if leaf[0] == lang}
        for leaf, b in pour(mine, b).items():
            total = sum(words[k] for k in leaves[leaf])
            if not total:
                continue
            whole, rest = divmod(b, total)
            out += [(rows[k][0], e, words[k]) for e in range(whole) for k in leaves[leaf]]
            order = sorted((hashlib.md5(f"{seed}:{whole}:{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest(), k)
                           for k in leaves[leaf])
            for _, k in order:
                if rest <= 0:
                    break
                out.append((rows[k][0], whole, min(rest, words[k])))
                rest -= words[k]
    return sorted(out, key=str)


@pytest.mark.parametrize("share, epochs", [((1, 1), 4), ((1, 3), 1), ((9, 1), 3)])
def test_mixing_brute_force(docs, share, epochs):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "en", "de", None]),
             rng.choice(["s1"] * 5 + ["s2", "s3", None])) for i in range(200)]
    rows += [(1000, None, "en", "s1"), (None, "a b", "fr", "s1"), (1001, "w " * 5000, "de", "s2"), (1002, "", "xx", "s9"),
             (1003, "never", "no", "s1")]
    weights = {"lang": {"en": 1, "de": 3, "fr": 5, "no": 0}, "source": {"s2": 2, "s3": 7}}
    got = mix(docs(rows).withColumn("take", F.lit("x")), {"lang": F.col("lang"), "source": F.col("source")}, weights,
              share, epochs, seed=11)
    assert sorted(((r.doc_id, r.epoch, r.take) for r in got.collect()), key=str) == brute_mix(rows, weights, share, epochs, 11)


def test_mixing_empty_repeated_and_prefix(spark, docs):
    levels = {"lang": F.col("lang")}
    assert mix(docs([]), levels, {}).count() == 0
    rows = [(1, "a b c")] * 3
    assert mix(docs(rows), levels, {}, (1, 1), 2).count() == 3
    df = spark.createDataFrame([(" a  b\tc ", 2)], "t string, n bigint")
    assert df.select(prefix(F.col("t"), F.col("n"))).first()[0] == "a b"


# --- the pipeline --------------------------------------------------------------------------------------

def test_pipeline_stages(spark, real, tmp_path):
    sf = "/root/testdata/sf0.01"
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line-dedup", "near-copies", "mixing", "packing"]
    seen, docs = {}, real[0]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if name != "packing":
            assert dict(docs.dtypes) == dict(real[0].dtypes)
            assert docs.where("n_chars <> length(text)").count() == 0
    labels = real[1]
    assert seen["quality"].join(labels.where("quality = 0"), "doc_id").count() < labels.where("quality = 0").count() / 2
    good = labels.where("quality = 1").count()
    assert seen["quality"].join(labels.where("quality = 1"), "doc_id").count() > 0.97 * good
    before = {r.doc_id: r.text for r in seen["quality"].collect()}
    lines = {r.doc_id: r.text for r in seen["line-dedup"].collect()}
    from test_dedup_ops import brute_lines
    assert lines == {i: t for i, t, _, _ in brute_lines(sorted(before.items()))}
    stay = {r.doc_id for r in seen["near-copies"].collect()}
    assert stay == {i for i, _, c in brute_jaccard(sorted(lines.items())) if i == c}
    mixed = seen["mixing"].collect()
    assert {r.doc_id for r in mixed} <= stay and len(mixed) > len(stay) // 2
    packed = seen["packing"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("t"))
    assert packed.count() == len({r.doc_id for r in mixed})
    assert seen["packing"].groupBy("sequence_id").agg(F.sum("length").alias("t")).where("t > 1024").count() == 0


def test_pipeline_empty_documents(spark, docs):
    out = docs([])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "/root/testdata/sf0.001")
    assert out.count() == 0
