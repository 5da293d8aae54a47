"""Source divergence, filter interaction and substring de-duplication against brute force."""
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrosight.llm import filter_audit as FA
from hydrosight.llm import source_audit as SA
from hydrosight.llm import substring_dedup as SD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------- source divergence --
def brute_sources(rows, min_docs, top):
    docs = [(lang or "", src or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))
            for _, t, lang, src in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if held[t] >= min_docs) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in counts.items():
            pairs = [(o, sum(abs(p(c, t) - p(counts[o], t)) for t in kept)) for o in counts if o != s]
            terms = [(t, p(c, t) - p(whole, t)) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(found[:most], 1)]
    return sorted(out)


def source_rows(seed=5, n=150):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["É", "éa", "naïve", "X" * 200]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "-", "9", "\n"]).join(
            rng.choice([str.upper, str])(words[min(int(rng.expovariate(0.1)), 63)]) for _ in range(rng.randint(0, 30)))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "é", "z", None])))
    return rows + [(900, None, "en", "void"), (901, "12 34", "xx", "only"), (None, "wa wa", "en", "a"), (7, "wb " * 50_000, "en", "a")]


def got_sources(df, **kw):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in SA.source_audit(df, **kw).collect())


def test_sources_brute_force(docs):
    rows = source_rows()
    assert got_sources(docs(rows), min_docs=4, top=5) == brute_sources(rows, 4, 5)


def test_sources_do_not_depend_on_blocks(docs, monkeypatch):
    rows = source_rows(seed=6, n=60)
    monkeypatch.setattr(SA, "BLOCK", 2)
    monkeypatch.setattr(SA, "TERMS", 7)
    assert got_sources(docs(rows), min_docs=2, max_postings=5, shards=3) == brute_sources(rows, 2, 50)


def test_merge_of_runs(monkeypatch):
    """Blocks of a few documents, in chunks of a few postings, add up to one count of all."""
    monkeypatch.setattr(SA, "CHUNK", 4)
    rows = source_rows(seed=8, n=80)
    names, chunks, want = SA.Names(), [], Counter()
    block = SA.Block()
    for i, (_, t, lang, src) in enumerate(rows):
        block.add(lang or "", src or "", (t or "").encode())
        for term in [*SA.terms_of((t or "").encode())]:
            want[term, lang or "", src or ""] += 1
        if i % 9 == 8 or i == len(rows) - 1:
            held = list(block.runs(5))
            assert all(c[1] == sorted(c[1]) for c in held)
            chunks += list(SA.chunks_of([SA._chunk_rows(held)], names))
            block = SA.Block()
    chunks.sort(key=lambda c: (c.shard, c.terms[0]))
    got = Counter()
    terms = []
    for term, held, found in SA.merged(iter(chunks)):
        terms.append(term)
        groups, counts, docs = SA.added(found)
        assert len(set(groups.tolist())) == len(groups) and docs.min() > 0 and docs.sum() == held
        for g, n in zip(groups.tolist(), counts.tolist()):
            got[term, names.langs[g], names.sources[g]] += n
    assert len(terms) == len(set(terms))
    assert +got == +want


def test_frequency_is_exact_for_large_counts(spark):
    rows = [(0, 0, 1), (10**13, 10**15, 10**6), (999_999_999_999, 10**12, 3), (7, 9 * 10**14, 10**9)]
    df = spark.createDataFrame(rows, "n bigint, t bigint, v bigint").select("*", SA.frequency(F.col("n"), F.col("t"), F.col("v")).alias("p"))
    for r in df.collect():
        assert r.p == 1 + 10**9 * (r.n + 5) // (r.t + 5 * r.v)


def test_sources_edges(docs):
    assert got_sources(docs([])) == []
    assert got_sources(docs([(1, "one two", "en", "s")])) == []
    clash = docs(source_rows(n=40)).withColumn("term", F.lit(1)).withColumn("shard", F.lit("s")).withColumn("p", F.lit("p"))
    assert got_sources(clash, min_docs=3) == brute_sources(source_rows(n=40), 3, 50)


# ------------------------------------------------------ filter interaction --
def test_positional_popcount():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 100, 4097):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        times = rng.integers(1, 1000, n) if n % 2 else np.ones(n, np.int64)
        want = [int(times[(words >> np.uint32(b)) & np.uint32(1) == 1].sum()) for b in range(32)]
        assert FA.positional_popcount(words, times).tolist() == want


def brute_audit(rows, labels):
    big = 1 << 63
    key = [big if r[0] is None else r[0] for r in rows]
    low = {}
    for k, r in zip(key, rows):
        low[r[1] or ""] = min(k, low.get(r[1] or "", big))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    cells = Counter()
    for k, (i, t, lang, _) in zip(key, rows):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": low[t] < k}
        cells[lang or "", frozenset(c for c in fails if fails[c]), i in good, i in toxic] += 1
    out = []
    for part in {c[0] for c in cells}:
        removals = Counter()
        here = []
        for order in itertools.permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                mine = [(f, g, x, n) for (p, f, g, x), n in cells.items() if p == part]
                cut = [(f, g, x, n) for f, g, x, n in mine if c in f and not f & set(order[:step - 1])]
                removed = sum(m[3] for m in cut)
                removals[c] += removed
                here.append(("".join(order), step, sum(n for f, *_, n in mine if not f & set(order[:step])), removed,
                             sum(n for f, *_, n in mine if c in f and f & set(order[:step - 1])),
                             sum(n for f, *_, n in mine if f == {c}), sum(m[3] for m in cut if m[1]), sum(m[3] for m in cut if m[2]), c))
        out += [(part, *h[:-1], removals[h[-1]]) for h in here]
    return sorted(out)


def audit_rows(seed=2, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(["alpha", "Beta", "GAMMA", "é", "d%d" % rng.randint(0, 400)]) for _ in range(rng.choice([3, 210, 260])))
        rows.append((i, text + rng.choice(["", " #", "\n"]), rng.choice(["en", "de", None]), "s"))
    rows += [(300 + i, rows[i % 9][1], rng.choice(["en", "fr"]), "s") for i in range(60)]
    return rows + [(500, None, "en", "s"), (501, "", "en", "s"), (None, rows[0][1], "en", "s"), (None, "alone #", None, "s"),
                   (None, "alone #", None, "s"), (3, rows[3][1], "en", "s"), (600, "word " * 100_000, "en", "s")]


def test_filter_audit_brute_force(spark, docs):
    rows = audit_rows()
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 400, 2)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    got = FA.filter_audit(docs(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, labels)


def test_filter_audit_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert FA.filter_audit(docs([]), none).count() == 0
    rows = audit_rows(n=20)
    clash = docs(rows).withColumn("failed", F.lit("x")).withColumn("good", F.lit(1)).withColumn("quality", F.lit(1))
    assert sorted(tuple(r) for r in FA.filter_audit(clash, none).collect()) == brute_audit(rows, [])
    with pytest.raises(ValueError):
        FA.filter_audit(docs(rows), none, {"A": FA.TEXT_FILTERS["A"]})


# ------------------------------------------------------------- substrings --
def brute_substrings(rows, span):
    big = 1 << 63
    split = [(big if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    first = {}
    for i, ws in split:
        for a in range(len(ws) - span + 1):
            w = tuple(ws[a:a + span])
            first[w] = min(i, first.get(w, big))
    out = []
    for (i, ws), row in zip(split, rows):
        gone = set()
        for a in range(len(ws) - span + 1):
            if first[tuple(ws[a:a + span])] < i:
                gone.update(range(a, a + span))
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        out.append((row[0], len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got_substrings(df, **kw):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in SD.substring_dedup(df, **kw).collect()), key=str)


def passage_rows(seed, n, vocab, span):
    """Passages that documents share whole, in part, overlapping and with changes."""
    rng = random.Random(seed)

    def some(k):
        return [rng.choice(vocab) for _ in range(k)]
    passages = [some(rng.randint(span - 2, 4 * span)) for _ in range(8)]
    rows = []
    for i in rng.sample(range(10 * n), n):
        ws = some(rng.randint(0, 2 * span))
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            a = rng.randint(0, 3) * rng.randint(0, 1)
            p = p[a:max(a + 1, len(p) - rng.randint(0, 5) * rng.randint(0, 1))]
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "changed"
            at = rng.randint(0, len(ws))
            ws[at:at] = p
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(ws)))
    rows += [(i + 100 * n, rows[j][1]) for i, j in enumerate(rng.choices(range(n), k=n // 4))]
    return rows + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " "), (None, rows[0][1]), (None, rows[0][1]), (rows[1][0], rows[1][1]),
                   (10**6 + 3, "same " * 400), (10**6 + 4, "same " * 300), (-5, "same " * 60 + "other")]


@pytest.mark.parametrize("seed,span,k,words", [(1, 50, 16, 400), (2, 12, 4, 3), (3, 6, 6, 2), (4, 5, 1, 4)])
def test_substrings_brute_force(docs, seed, span, k, words):
    rows = passage_rows(seed, 120, [f"t{i}" for i in range(words)], span)
    want = brute_substrings(rows, span)
    assert got_substrings(docs(rows), span=span, k=k) == want
    assert sum(r[2] for r in want) > 500


def test_substrings_edges(spark, docs):
    assert got_substrings(docs([])) == []
    rows = passage_rows(9, 30, [f"t{i}" for i in range(50)], 50)
    clash = docs(rows).withColumn("row", F.lit("r")).withColumn("n_words", F.lit("n")).withColumn("anchor", F.lit(1))
    assert got_substrings(clash) == brute_substrings(rows, 50)


def test_word_hashes_do_not_depend_on_the_place():
    """The last word of a text, long words and words after a slice's edge hash as anywhere else."""
    words = [b"a", b"b" * 10, b"c" * (SD.SLICE + 5), b"a", "é".encode(), b"d" * (SD.SLICE // 2), b"d" * (SD.SLICE // 2), b"a"]
    joined = b" ".join(words)
    h = SD.word_hashes(joined, SD.word_starts(joined))
    assert len(set(h[[0, 3, 7]].tolist())) == 1 and h[5] == h[6]
    for w, x in zip(words, h):
        assert SD.word_hashes(w, SD.word_starts(w))[0] == x


def test_leftmost_minima(monkeypatch):
    monkeypatch.setattr(SD, "STRETCH", 64)
    rng = np.random.default_rng(3)
    for n, width in ((1, 1), (40, 7), (500, 35), (300, 300)):
        v = rng.integers(0, 5, n).astype(np.uint64) << np.uint64(40)
        want = [a + int(np.argmin(v[a:a + width])) for a in range(n - width + 1)]
        assert SD.leftmost_minima(v, width).tolist() == want
