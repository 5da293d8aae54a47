"""Language, toxicity and quality: held-out accuracy, parts against brute force, edge rows."""
import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from hydrosight.llm.langid import language_id
from hydrosight.llm.common import WS
from hydrosight.llm.quality import features as quality_features
from hydrosight.llm.quality import quality
from hydrosight.llm.toxicity import Matcher, features, toxicity


def test_language_held_out_accuracy(real):
    out = language_id(real[0]).join(real[0].select("doc_id", "lang"), "doc_id")
    r = out.where("held_out").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok"),
                                  F.min("score"), F.max("score")).first()
    assert r.n > 200 and r.ok / r.n > 0.95 and 0 <= r[2] <= r[3] <= 1


def test_language_edges(docs):
    rows = [(i, "the cat and the dog " * 5 + str(i), "en") for i in range(30)]
    rows += [(100 + i, "der hund und die katze " * 5 + str(i), "de") for i in range(30)]
    rows += [(300, None, "en"), (301, "", "de"), (302, "123 ++ ½", None), (303, "der und die", None), (None, "the dog", "en"),
             (304, "the cat " * 50_000, None), (1, rows[1][1], "en"), (305, "зима лето осень" * 9, None)]
    out = language_id(docs(rows).withColumn("rejected", F.lit(1)))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert [got[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3
    assert got[303].lang_pred == "de" and got[304].lang_pred == "en" and got[None].lang_pred == "en"
    assert got[305].lang_pred in ("en", "de") and got[305].rejected
    und = {r.doc_id: r.lang_pred for r in language_id(docs(rows), reject_as_und=True).collect()}
    assert und[305] == "und"
    assert language_id(docs([])).count() == 0
    assert {r.lang_pred for r in language_id(docs([(1, "a b", None)])).collect()} == {"und"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_matcher_equals_brute_force():
    rng = random.Random(5)
    terms, stems = ["stupid", "idiot", "scum", "aabba"], ["lowei", "chll"]
    m = Matcher(terms, stems)
    words = ["".join(rng.choice("abcdehilopstuw") for _ in range(rng.randint(1, 8))) for _ in range(4000)]
    for t in terms + [s + "xyz" for s in stems]:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w) + 1)
                w[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "e", "z"])
            words.append("".join(w))
    for w in words:
        want = [distance(w, t) for t in terms if distance(w, t) <= (len(t) >= 5)]
        want += [d for s in stems for n in range(len(w) + 1) for d in [distance(w[:n], s)] if d <= (len(s) >= 5)]
        assert m.match(w) == min(want, default=None), w


def test_context_separates_quotation():
    m = Matcher(["idiot", "stupid"], [])
    abuse, quoted = features("you are an idiot and stupid", m, 50), features('they said "you are an idiot and stupid" then', m, 50)
    assert abuse[0] > 0 and abuse[2] == 0 and quoted[0] == 0 and quoted[2] > 0
    assert features("idoit? no: an idiott", m, 50)[1] > 0
    assert features(None, m, 50) == features("", m, 50) == (0.0,) * 6


@pytest.mark.parametrize("word", ["idi0t", "id1ot", "i1diot", "st*pid", "stup!d", "m@ron", "mor0n", "stu_pid", "MOR0N"])
def test_words_with_substitute_signs_match_within_an_edit(word):
    m = Matcher(["idiot", "stupid", "moron"], [])
    f = features(f"you are a {word}", m, 50)
    assert f[0] == 0 and round(math.expm1(f[1])) == 1 and f[2] == 0
    assert features(f'they said "{word}" then', m, 50)[2] > 0


def test_substitute_signs_hide_no_whole_word():
    m = Matcher(["idiot", "stupid"], ["lowei"])
    assert features("idiot@home *stupid* idiot1", m, 50) == features("idiot home stupid idiot", m, 50)
    assert features("m3n r2d2 a@b.org 1d10t i**d**t", m, 50) == (0.0,) * 6
    assert features("a" * 300_000 + "1" * 300_000 + "b", m, 50) == (0.0,) * 6


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w, toxic = [rng.choice(words) for _ in range(rng.randint(5, 60))], i % 5 == 0
        if toxic:
            for t in rng.sample(["idiot", "stupid", "moron", "pathetic"], 3):
                w.insert(rng.randrange(len(w)), t if rng.random() < 0.9 else t[:2] + t[3:])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (None, "idiot"), (902, "calm " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("label", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (901, None), (None, 1)], "doc_id bigint, toxic int")
    out = toxicity(df, lab).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    want = dict(labels)
    held = [(r.predicted, want[r.doc_id]) for r in out if r.held_out and r.doc_id in want]
    assert sum(p == w for p, w in held) / len(held) > 0.95
    assert {r.predicted for r in out if r.doc_id in (900, 901, 902)} == {0}
    assert toxicity(df.limit(0), lab).count() == 0
    assert {r.score for r in toxicity(df, lab.limit(0)).collect()} == {0.0}


def test_quality_held_out(real):
    docs, labels = real
    out = quality(docs, labels).join(labels, "doc_id").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    r = out.where("held").agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")).alias("acc")).first()
    clean = out.where("held and quality = 1").agg(F.avg(F.col("kept").cast("int")).alias("kept")).first()
    assert r.acc > 0.93 and clean.kept > 0.95


def test_quality_shrinks_sparse_sites(spark):
    rows, labels = [], []
    for i in range(400):  # host h0 mostly bad, h1 good, h2 has one document
        host, good = ("h0", i % 10 == 0) if i < 200 else ("h1", i % 10 != 0)
        rows.append((i, ("the quiet words of a plain text " * 4) if good else "$$$ ### &&& %%% " * 6, "en", host))
        labels.append((i, int(good)))
    middling = "the quiet $$ words ## of a && plain text "
    rows += [(1000, middling, "en", "h0"), (1001, middling, "en", "h1"), (1002, middling, "en", "h2"), (1003, None, None, None),
             (None, middling, "en", "h1"), (1004, "", "en", "h0"), (1005, "the quiet words " * 40_000, "en", "h1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    lab = spark.createDataFrame([*labels, (1004, None)], "doc_id bigint, quality int")
    out = quality(df.withColumn("score", F.lit("x")).withColumn("bins", F.lit(0)), lab)
    s = {r.doc_id: r.score for r in out.collect()}
    assert out.count() == len(rows) and all(0 <= x <= 1 for x in s.values())
    assert s[1000] < s[1002] < s[1001]
    assert quality(df.limit(0), lab).count() == 0
    assert {(r.score, r.kept) for r in quality(df, lab.limit(0)).collect()} == {(0.5, True)}


@pytest.mark.parametrize("n", [0, 1])
def test_language_repeated_rows(docs, n):
    rows = [(1, "the cat and the dog", "en")] * (3 * n)
    assert language_id(docs(rows)).count() == 3 * n


def test_quality_features_by_unicode_category(spark):
    rng, old = random.Random(3), unicodedata.ucd_3_2_0
    kinds = {}  # by category; characters whose category no version has changed
    for i in range(0x110000):
        c = chr(i)
        if old.category(c) == unicodedata.category(c) not in ("Cs", "Cn"):
            kinds.setdefault(unicodedata.category(c), []).append(c)
    texts = ["★★★ ▓▒░ the♦♦♦ and●●●", "ПЛОХОЙ ТЕКСТ БЕЗ СЛОВ", "â€™ Ã© â€œ cafÃ©", "Éa éa ÉA \U0001f600 ½ Ⅷ ٣ ǅ", "", "ab C1 $",
             "ГОД год\u00a0Год", "ΟΔΟΣ οδος", "e\u0301 漢字 𝐀𝐛"]
    for _ in range(300):
        picked = rng.sample(sorted(kinds), rng.randint(1, 5)) + ["Ll", "Zs"]
        texts.append("".join(rng.choice([rng.choice(kinds[rng.choice(picked)]), rng.choice("aZ 7.$\t")])
                             for _ in range(rng.randint(1, 80))))
    # the expressions that the array form took the place of
    t = F.col("text")
    words = F.filter(F.split(F.lower(t), f"[{WS}]+"), lambda w: w != "")
    n, size = F.size(words), F.greatest(F.length(t), F.lit(1))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    want = [F.length(F.regexp_replace(t, rf"[\p{{L}}\p{{N}}{WS}.,;:'\"()\-]+", "")) / size,
            F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")) / F.greatest(letters, F.lit(1)),
            F.length(F.regexp_replace(t, r"[^0-9]+", "")) / size, letters / F.greatest(n, F.lit(1)), n.cast("double"),
            F.size(F.array_distinct(words)) / F.pow(F.greatest(n, F.lit(1)), F.lit(0.8))]
    for r in spark.createDataFrame([(x,) for x in texts], "text string").select("text", F.array(*want).alias("want")).collect():
        assert quality_features(r.text.encode()) == pytest.approx(r.want), r.text
    assert quality_features("★★★ ▓▒░".encode())[0] > 0.8 and quality_features("ПЛОХОЙ".encode())[1] == 1


def test_quality_features_of_broken_utf8():
    assert quality_features(b"ab\xff\xfe cd")[0] == pytest.approx(2 / 7)


def test_quality_sites_learn_from_labels(spark):
    # one text everywhere: only the labels of a site tell it from another
    rows = [(i, "the quiet words of a plain text", "en", f"h{i % 2}") for i in range(400)]
    labels = [(i, 1 - i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    lab = spark.createDataFrame(labels + labels[:100], "doc_id bigint, quality int")
    low, high = (quality(df, lab).where(F.col("source") == h).agg(F.avg("score")).first()[0] for h in ("h1", "h0"))
    assert low < 0.3 and high > 0.7
