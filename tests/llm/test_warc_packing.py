"""WARC and packing: exact round trips."""
import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hydrosight.llm.common import scratch
from hydrosight.llm.packing import cuts, encoder, pack, plan
from hydrosight.llm.queries import op8_packing
from hydrosight.llm.warc import parse, read_warc, record, write_warc



def padded(total, size):
    """The tokens of a sequence after padding: none at a power of two."""
    return total if total & (total - 1) == 0 else size


PAGES = [(1, "http://a/", "<p>é</p>"), (2, "http://b/\r\nX: y", "<p>é</p>"), (3, None, None), (4, "http://d/", ""),
         (5, "http://e/", "x" * 300_000), (None, "http://n/", "<p>é</p>"), (6, "http://f/", "a\r\n\r\nb"),
         (2, "http://b2/", "<p>é</p>")]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


@pytest.mark.parametrize("min_bytes", [0, 5, 100])
def test_warc_round_trip(spark, min_bytes):
    index = write_warc(pages(spark, PAGES), scratch(spark, "warc"), min_bytes=min_bytes)
    got = sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                   None if r.payload is None else bytes(r.payload)) for r in read_warc(index).collect()), key=str)
    want = []
    for i, url, html in PAGES:
        p = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "").encode() == p and j is not None]
        last = max(same, default=None) if len(p) >= min_bytes else i
        want.append((i, url, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
                     "response" if i == last else "revisit", None if i == last else last, p if i == last else None))
    assert got == sorted(want, key=str)


def test_warc_reads_only_selected_ranges(spark):
    index = write_warc(pages(spark, PAGES), scratch(spark, "warc"))
    one = read_warc(index.where("page_id in (4, 5)"), max_gap=0, max_read=10).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in one) == [(4, 0), (5, 300_000)]


def test_warc_empty_and_clashing(spark):
    assert read_warc(write_warc(pages(spark, []), scratch(spark, "warc"))).count() == 0
    df = pages(spark, PAGES[:2]).withColumn("digest", F.lit("d")).withColumn("payload", F.lit(0))
    assert read_warc(write_warc(df, scratch(spark, "warc"))).count() == 2


def test_warc_finds_damage():
    raw = record(1, "u", b"payload", base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), None, "d")
    assert parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        parse(raw.replace(b"payload\r\n\r\n", b"Payload\r\n\r\n"))


FILE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", "Hello  world\n\n\tx", "Ünïcödé 漢字 \U0001f600 é", "don't we'll I'M 1234 ²½", "    z ",
         "<|endoftext|> in a text", "a" * 5000, " " * 300, "\x00\x7f\r\n", "word " * 3000]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_encoder_equals_the_tokenizers_library(text):
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    assert list(encoder(FILE)(text)) == t.encode(text, add_special_tokens=False).ids


def test_pack_round_trip(docs, real, reference):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (None, "null id"), (1, "a")]
    rows += [(100 + r.doc_id, r.text) for r in real[0].limit(300).collect()]
    out = pack(docs(rows), FILE, size=256, with_ids=True).collect()
    by_doc = {}
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append((r.start, list(np.frombuffer(r.ids, "<u4")), r.doc_tokens))
    for i, t in {i: t for i, t in rows}.items():
        ids = reference(t or "") + [0]
        got = sorted(by_doc[i])
        copies = sum(j == i for j, _ in rows)
        assert sorted(x for _, p, _ in got for x in p) == sorted(ids * copies)
        if copies == 1:
            assert [x for _, p, _ in got for x in p] == ids and {n for _, _, n in got} == {len(ids)}
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    waste = volume = 0
    for s in seqs.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= 256
        volume, waste = volume + end, waste + padded(end, 256) - end
    assert waste < 0.03 * volume


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 2_000_000, " \u00a0\n" * 700_000])
def test_encoder_takes_long_runs_of_white_space(reference, run):
    text = "a b" + run + "c 1"
    assert np.array_equal(encoder(FILE)(text), reference(text))


def test_encoder_takes_the_longest_runs_of_its_pattern(reference):
    for n in (100_000, 100_001):
        assert np.array_equal(encoder(FILE)("a" + " " * n + "b"), reference("a" + " " * n + "b"))


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext", "<|endoftext|>" + " " * 150_000 + "b"]


def test_special_tokens_equal_the_plain_tokenizers_call(docs):
    t = Tokenizer.from_file(FILE)
    want = [t.encode(x, add_special_tokens=False).ids for x in SPECIAL + TEXTS]
    assert want[0] == [64, 220, 50256, 275]
    assert [list(encoder(FILE, special=True)(x)) for x in SPECIAL + TEXTS] == want
    got = {}
    for r in pack(docs(list(enumerate(SPECIAL))), FILE, with_ids=True, special=True).orderBy("start").collect():
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4"))
    assert [got[i] for i in range(len(SPECIAL))] == [w + [0] for w in want[:len(SPECIAL)]]


def test_op8_query_gives_special_tokens_their_ids(spark, docs, tmp_path):
    docs([(1, "a <|endoftext|> b")]).write.parquet(str(tmp_path / "documents.parquet"))
    (r,) = op8_packing(spark, str(tmp_path)).collect()
    assert r.ids_crc32 == zlib.crc32(np.array([64, 220, 50256, 275, 0], "<u4").tobytes()) and r.doc_tokens == 5


def test_pack_takes_a_long_run_of_white_space(docs, reference):
    text = "a" + " " * 2_000_000 + "b"
    out = pack(docs([(1, text), (2, "c")]), FILE, with_ids=True).orderBy("doc_id", "start").collect()
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in out if r.doc_id == 1])
    assert np.array_equal(ids, reference(text) + [0])
    assert [list(np.frombuffer(r.ids, "<u4")) for r in out if r.doc_id == 2] == [reference("c") + [0]]


def test_pack_empty_and_clashing(docs):
    assert pack(docs([]), FILE).count() == 0
    df = docs([(1, "a b"), (2, "c")]).withColumn("units", F.lit(1)).withColumn("rank", F.lit("x"))
    assert pack(df, FILE).count() == 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), min_size=1, max_size=20))
def test_plan_places_each_piece_once(histogram):
    used, slots = {}, set()
    for n, rows in plan(histogram, 32).items():
        for rank in range(histogram[n]):
            p = rows[np.searchsorted(rows[:, 0], rank, side="right") - 1]
            k = rank - p[0]
            s = int(p[1] + k // p[2])
            used[s] = used.get(s, 0) + n
            slot = (s, int(p[3] + k % p[2]))
            assert slot not in slots
            slots.add(slot)
    assert max(used.values()) <= 32
    # the half rule is the caller's; first-fit's bound on sequences must hold anyway
    volume = sum(n * m for n, m in histogram.items())
    assert len(used) <= 2 * -(-volume // 32) + 1


@given(st.integers(1, 5000))
def test_cuts_cover(n):
    pos = 0
    for a, m in cuts(n, 1024):
        assert a == pos and 0 < m <= 1024
        pos += m
    assert pos == n
