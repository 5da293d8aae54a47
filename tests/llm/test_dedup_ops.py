"""Exact and line de-duplication against brute force, with edge rows."""
import hashlib
import random
import re
import uuid

from pyspark.sql import functions as F

from hydrosight.llm.common import scratch
from hydrosight.llm.exact_dedup import DigestIndex, exact_dedup
from hydrosight.llm.line_dedup import line_dedup

ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (7, None), (8, ""), (None, "a b"), (4, "x" * 200_000),
        (6, "x" * 200_000), (6, "x" * 200_000), (1, "É e"), (2, "É e")]


def test_exact_dedup_brute_force(docs):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs(ROWS)).collect()),
                 key=str)
    norm = [(i, re.sub("[\x20\x09-\x0D]+", " ", t or "")) for i, t, *_ in ROWS]
    want = []
    for i, t in norm:
        same = [j for j, u in norm if u == t]
        keep = min((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_exact_dedup_empty_and_clashing_columns(spark, docs):
    assert exact_dedup(docs([])).count() == 0
    clash = docs([(1, "a"), (2, "a")]).withColumn("digest", F.lit(1)).withColumn("kept", F.lit("x"))
    assert sorted((r.doc_id, r.kept) for r in exact_dedup(clash).collect()) == [(1, True), (2, False)]


def test_digest_index_grows_and_remembers(spark, docs):
    name = f"ix_{uuid.uuid4().hex[:8]}"
    index = DigestIndex(spark, name, path=scratch(spark, name), buckets=4)
    exact_dedup(docs([(10, "one"), (11, "two")]), index).collect()
    again = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup(docs([(1, "one"), (2, "new"), (3, "new")]), index).collect()}
    assert again == {1: (10, False), 2: (2, True), 3: (2, False)}
    assert index.read().count() == 3 and index.read().select("digest").distinct().count() == 3
    index2 = DigestIndex(spark, name)  # a later job finds the table
    assert index2.read().count() == 3


def brute_lines(rows, min_chars=40, min_docs=5):
    ws = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = [[x.strip(ws).translate(low) for x in (t or "").split("\n")] for _, t in rows]
    holders = {}
    for (i, _), ks in zip(rows, keys):
        for k in set(ks):
            if len(k) >= min_chars:
                holders.setdefault(k, []).append(i)
    out = []
    for (i, t), ks in zip(rows, keys):
        lines = (t or "").split("\n")
        gone = [len(holders.get(k, ())) >= min_docs
                and i != max((h for h in holders[k] if h is not None), default=None) for k in ks]
        out.append((i, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(out, key=str)


def line_rows(seed=3, n=120):
    rng = random.Random(seed)
    common = ["The common line number %d that is long enough to count é" % k for k in range(4)]
    common.append("É" * 39)  # too short by code points, long enough by bytes
    common.append("É" * 40)
    rows = []
    for i in range(n):
        lines = [rng.choice(common) if rng.random() < 0.3 else "unique line %d %f with some more words in it" % (i, rng.random())
                 for _ in range(rng.randint(1, 8))]
        lines = [rng.choice(["", "  ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", " \r"]) for x in lines]
        rows.append((i, "\n".join(lines)))
    return rows + [(500, None), (501, ""), (502, "\n\n"), (None, common[0]), (7, rows[7][1]), (600, "z" * 300_000)]


def test_line_dedup_brute_force(docs):
    rows = line_rows()
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup(docs(rows)).collect()), key=str)
    assert got == brute_lines(rows)
    assert sum(r[3] for r in got) > 50


def test_line_dedup_does_not_depend_on_the_filter(docs):
    rows = line_rows(seed=4, n=60)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in
                  line_dedup(docs(rows), bits_per_key=1, max_filter_mb=1).collect()), key=str)
    assert got == brute_lines(rows)


def test_line_dedup_empty_and_clashing_columns(docs):
    assert line_dedup(docs([])).count() == 0
    df = docs([(i, "this line is shared by all of these documents") for i in range(6)])
    df = df.withColumn("rid", F.lit("r")).withColumn("n_lines", F.lit("old")).withColumn("suspect", F.lit(7))
    out = line_dedup(df).orderBy("doc_id").collect()
    assert [r.n_dropped for r in out] == [1, 1, 1, 1, 1, 0]
    assert {(r.rid, r.suspect, r.n_lines) for r in out} == {("r", 7, 1)}
