"""Substring de-duplication by a compacted De Bruijn graph of the corpus's words.

Windows of ``span`` words are the edges of the graph. A word that a window covers
goes when the window's words also start in a document with a smaller id.

1. One scan cuts each document's windows into pieces: runs of consecutive windows
   whose smallest hash of ``k`` words is the same occurrence, the piece's anchor. The
   anchor of a window depends on its words only, so equal windows have equal anchors
   wherever they are. A piece is known by its anchor's hash and by a 16-byte digest of
   the words at its coordinates (row, first window, windows): about one piece
   for ``(span - k) / 2`` words is what is shuffled, not one row a window.
2. Equal pieces meet: smallest and largest document, and whether one piece always
   follows and always precedes. Anchors that one document holds alone are done.
3. Repeated pieces that do not branch compact into paths: joins double each piece's
   pointer along the chain until all rest at its end, so a passage of any length is
   one row, known by its first piece.
4. Where an anchor has several pieces, paths branch: their windows are hashed at the
   coordinates of one occurrence each, and the smallest document of every
   window found; only windows that a smaller document holds stay.
5. Paths and branch windows meet the coordinates of all documents: a later document
   loses the whole path, the first document of a piece those windows that are
   older still. Only texts with such spans move; their remaining words are hashed.

A key of a join that holds over a thousandth of the rows (at most a thousand such keys,
so their broadcast is bounded) is joined where the rows lie; the others are shuffled.
Texts that move are found by a bitmap of ``FILTER_BITS`` bits; a fuller one moves more texts.
Memory: a task holds a batch of texts, and arrays of eight bytes a word of one text at a time.

Defined cases
    null or empty text   no words; kept_sha256 is that of the empty text
    null doc_id          larger than any id: such a document loses what a document with
                         an id holds; documents without id do not take from each other
    repeated rows        rows of one doc_id do not take from each other
    long texts           taken whole
    texts under ``span`` words   keep all words
    empty table          empty result
    clashing columns     only the id and text columns are read
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrosight.llm.common import cut, small_batches

LARGEST_ID = (1 << 63) - 1
FILTER_BITS = 1 << 24
#: windows whose anchors are found at a time; positions inside fit in 24 bits
STRETCH = 1 << 22
#: bytes of words hashed at a time; a longer word is hashed by itself
SLICE = 1 << 20
_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def word_starts(joined: bytes) -> np.ndarray:
    """Byte positions of the words of text joined by single spaces, then one past the end plus one."""
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.concatenate([[0], spaces + 1, [len(joined) + 1]])


def word_hashes(joined: bytes, starts: np.ndarray) -> np.ndarray:
    """A hash of each word. Hashes pick anchors; digests of the words decide what is equal."""
    text = np.frombuffer(joined + b" ", np.uint8)  # each word with the space after it
    n = len(starts) - 1
    out = np.empty(n, np.uint64)
    a = 0
    while a < n:
        z = int(np.searchsorted(starts, starts[a] + SLICE, "right")) - 1
        if z <= a:  # one long word
            out[a] = xxhash.xxh3_64_intdigest(joined[starts[a]:starts[a + 1] - 1] + b" ")
            a += 1
            continue
        at = starts[a:z] - starts[a]
        part = text[starts[a]:starts[z]]
        place = np.arange(len(part)) - np.repeat(at, np.diff(at, append=len(part)))
        out[a:z] = np.add.reduceat(_BYTE[part] * _PLACE[place & 0xFFFF], at)
        a = z
    return _mixed(out)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words."""
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j:len(h) - k + 1 + j]
    return _mixed(out)


def leftmost_minima(v: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of ``width`` values the position of its smallest, leftmost of ties
    (by the upper 40 bits): minima from the left and from the right of blocks of ``width``."""
    n = len(v) - width + 1
    out = np.empty(n, np.int64)
    for a in range(0, n, STRETCH):
        m = min(STRETCH, n - a)
        part = v[a:a + m + width - 1]
        key = (part & ~np.uint64((1 << 24) - 1)) | np.arange(len(part), dtype=np.uint64)
        blocks = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        blocks[:len(key)] = key
        blocks = blocks.reshape(-1, width)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(right[:m], left[width - 1:width - 1 + m])
        out[a:a + m] = (low & np.uint64((1 << 24) - 1)).astype(np.int64) + a
    return out


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def pieces(joined: bytes, span: int, k: int):
    """The pieces of a text whose words are joined by single spaces: anchor hashes, digests (one
    bytes object), first windows, numbers of windows."""
    starts = word_starts(joined)
    if len(starts) - 1 < span:
        return np.empty(0, np.int64), b"", np.empty(0, np.int64), np.empty(0, np.int64)
    v = run_hashes(word_hashes(joined, starts), k)
    at = leftmost_minima(v, span - k + 1)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    count = np.concatenate([first[1:], [len(at)]]) - first
    begin, end = starts[first].tolist(), (starts[first + count + span - 1] - 1).tolist()
    digests = b"".join([_digest(joined[a:b]) for a, b in zip(begin, end)])
    return v[at[first]].view(np.int64), digests, first, count


_PIECES = "anchor array<bigint>, d0 array<bigint>, d1 array<bigint>, start array<int>, windows array<int>"


def _scan(span: int, k: int):
    def run(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts, shas, counts, found = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = text.split()  # bytes split at exactly \x20 and \x09-\x0D
                joined = b" ".join(words)
                texts.append(joined)
                shas.append(hashlib.sha256(joined).hexdigest())
                counts.append(len(words))
                found.append(pieces(joined, span, k))
            digests = np.frombuffer(b"".join(f[1] for f in found), np.int64).reshape(-1, 2)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32))

            def lists(values, dtype):
                return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(values, dtype)))
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column(0), pa.array(counts, pa.int64()),
                 pa.array(shas), pa.array(texts, pa.binary()),
                 lists(np.concatenate([f[0] for f in found]), np.int64), lists(digests[:, 0], np.int64),
                 lists(digests[:, 1], np.int64), lists(np.concatenate([f[2] for f in found]), np.int32),
                 lists(np.concatenate([f[3] for f in found]), np.int32)],
                names=["row", "id", "n_words", "sha", "text", "anchor", "d0", "d1", "start", "windows"])
            row += n
    return run


def _coordinates(batches):
    """One row per piece of (row, id, lists), with the digests of its neighbours in the text."""
    for batch in batches:
        lists = batch.column(2)
        ends = lists.offsets.to_numpy()
        n = len(lists.flatten())
        if not n:
            continue
        ends = ends - ends[0]
        sizes = np.diff(ends)
        cols = [batch.column(i).flatten() for i in range(2, 7)]
        d0, d1 = cols[1].to_numpy(), cols[2].to_numpy()
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[ends[:-1][sizes > 0]] = True
        last[ends[1:][sizes > 0] - 1] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.repeat(batch.column(1).to_numpy(), sizes)),
             *cols, pa.array(np.roll(d0, -1), mask=last), pa.array(np.roll(d1, -1), mask=last),
             pa.array(np.roll(d0, 1), mask=first)],
            names=["row", "id", "anchor", "d0", "d1", "start", "windows", "next0", "next1", "before0"])


_COORDINATES = ("row bigint, id bigint, anchor bigint, d0 bigint, d1 bigint, start int, windows int, "
                "next0 bigint, next1 bigint, before0 bigint")


def _windows(span: int):
    """(text, pieces wanted) -> one row per window of each: the digest of its words and the piece's key."""
    def run(batches):
        for batch in batches:
            out, digests = [], []
            for text, wanted in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                starts = word_starts(text)
                for p in wanted:
                    for j in range(p["windows"]):
                        a = p["start"] + j
                        digests.append(_digest(text[starts[a]:starts[a + span] - 1]))
                        out.append((p["d0"], p["d1"], p["low"], j))
            if out:
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), *(pa.array(c, pa.int64()) for c in zip(*out))],
                    names=["w0", "w1", "d0", "d1", "low", "at"])
    return run


def _without(span: int):
    """Takes the words of the spans (first window, windows) out of the texts."""
    def run(batches):
        for batch in batches:
            rows, removed, shas = batch.column(0), [], []
            for text, spans in zip(*(batch.column(i).to_pylist() for i in (1, 2))):
                words = text.split(b" ")
                covered = np.zeros(len(words) + 1, np.int64)
                np.add.at(covered, [s["start"] for s in spans], 1)
                np.add.at(covered, [s["start"] + s["windows"] + span - 1 for s in spans], -1)
                kept = [w for w, c in zip(words, np.cumsum(covered[:-1]).tolist()) if not c]
                removed.append(len(words) - len(kept))
                shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([rows, pa.array(removed, pa.int64()), pa.array(shas)],
                                             names=["row", "n_removed", "kept"])
    return run


def heavy_join(many: DataFrame, few: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """Inner join. ``few`` says in ``rows`` how many rows of ``many`` a key has: keys over a thousandth
    of the sum are broadcast (a thousand at most), so no task meets all rows of a hot key."""
    total = few.agg(F.sum(rows)).first()[0] or 0
    hot = F.col(rows) * 1000 > total
    heavy = F.broadcast(few.where(hot))
    cold = many.join(heavy.select(*keys).distinct(), keys, "left_anti").join(few.where(~hot), keys)
    return many.join(heavy, keys).unionByName(cold)


def maybe_in(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row`` may be among those of ``rows``: all that are, and few others
    while the bitmap is sparse."""
    slot = F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))
    bitmap = rows.select((slot / 64).cast("int").alias("cell"), bit.alias("bit")).groupBy("cell").agg(
        F.bit_or("bit").alias("set"))  # FILTER_BITS / 64 rows at most
    found = docs.withColumns({"cell": (slot / 64).cast("int"), "bit": bit}).join(F.broadcast(bitmap), "cell")
    return found.where(F.col("set").bitwiseAND(F.col("bit")) != 0).drop("cell", "bit", "set")


def compact_paths(nodes: DataFrame) -> DataFrame:
    """Chains of repeated pieces, by pointer doubling: (d0, d1) of each chain's first piece, its ``low``,
    ``rows``, and the windows of the whole chain. ``nodes`` has a piece's windows, its one next piece
    (next0, next1; null where it ends or branches) and whether one piece alone precedes it."""
    nodes = cut(nodes, "paths-pieces")
    inner = nodes.where("one_before").select(F.col("d0").alias("next0"), F.col("d1").alias("next1"))
    links = cut(nodes.where("next0 is not null").join(inner, ["next0", "next1"]).select(
        "d0", "d1", "next0", "next1"), "paths-links")
    targets = links.select(F.col("next0").alias("d0"), F.col("next1").alias("d1"))
    heads = nodes.join(targets, ["d0", "d1"], "left_anti")
    chained = nodes.select("d0", "d1", "windows").join(
        links.select("d0", "d1").union(targets).distinct(), ["d0", "d1"]).join(links, ["d0", "d1"], "left")
    chained = cut(chained, "paths-chains")
    while not chained.where("next0 is not null").isEmpty():
        ahead = chained.select(F.col("d0").alias("next0"), F.col("d1").alias("next1"), F.col("windows").alias("more"),
                               F.col("next0").alias("far0"), F.col("next1").alias("far1"))
        chained = cut(chained.join(ahead, ["next0", "next1"], "left").select(
            "d0", "d1", (F.col("windows") + F.coalesce("more", F.lit(0))).alias("windows"),
            F.col("far0").alias("next0"), F.col("far1").alias("next1")), "paths-chains")
    whole = chained.select("d0", "d1", F.col("windows").alias("chain"))
    return heads.select("d0", "d1", "low", "rows", "windows").join(whole, ["d0", "d1"], "left").select(
        "d0", "d1", "low", "rows", F.coalesce("chain", "windows").alias("windows"))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 50,
                    k: int = 16) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row, and ``spans``: the (start, windows) that
    another document holds first, in words of the row (empty where nothing goes)."""
    if not 1 <= k <= span:
        raise ValueError("anchors must fit in a window")
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LARGEST_ID)).alias("id"),
                     F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    with small_batches(spark):
        docs = cut(rows.mapInArrow(_scan(span, k), "row bigint, id bigint, n_words bigint, sha string, text binary, "
                                   + _PIECES), "substring-docs")
    places = docs.select("row", "id", "anchor", "d0", "d1", "start", "windows").mapInArrow(_coordinates, _COORDINATES)

    def one(*columns):
        """True when all rows have one and the same value."""
        same = [F.min(c) == F.max(c) for c in columns]
        return F.coalesce((F.count(columns[0]) == F.count(F.lit(1))) & same[0] & same[-1], F.lit(False))
    found = places.groupBy("anchor", "d0", "d1").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("rows"),
        F.max("windows").cast("bigint").alias("windows"), F.min("row").alias("row"), F.min_by("start", "row").alias("start"),
        F.when(one("next0", "next1"), F.min("next0")).alias("next0"),
        F.when(one("next0", "next1"), F.min("next1")).alias("next1"), one("before0").alias("one_before"))
    found = cut(found, "substring-pieces")
    anchors = cut(found.groupBy("anchor").agg(F.min("low").alias("a_low"), F.max("high").alias("a_high"),
                                              F.count(F.lit(1)).alias("a_pieces"))
                  .where("a_low < a_high and a_pieces > 1").select("anchor", "a_pieces"), "substring-anchors")

    paths = compact_paths(found.where("low < high").select("d0", "d1", "low", "rows", "windows", "next0", "next1",
                                                           "one_before"))
    marks = paths.select("d0", "d1", "low", "rows", F.lit(True).alias("whole"),
                         F.array(F.struct(F.lit(0).cast("bigint").alias("at"), "windows")).alias("parts"))

    branching = cut(heavy_join(found.select("anchor", "d0", "d1", "low", "rows", "windows", "row", "start"), anchors,
                               ["anchor"], "a_pieces"), "substring-branches")
    wanted = branching.groupBy("row").agg(  # pieces of one text
        F.collect_list(F.struct("start", "windows", "d0", "d1", "low")).alias("wanted"))
    texts = maybe_in(docs.select("row", "text"), branching.select("row"))
    with small_batches(spark):
        windows = cut(texts.join(wanted, "row").select("text", "wanted").mapInArrow(
            _windows(span), "w0 bigint, w1 bigint, d0 bigint, d1 bigint, low bigint, at bigint"), "substring-windows")
    older = cut(windows.groupBy("w0", "w1").agg(F.min("low").alias("w_low"), F.max("low").alias("w_high"),
                                                F.count(F.lit(1)).alias("w_rows")).where("w_low < w_high"),
                "substring-older")
    lost = heavy_join(windows, older, ["w0", "w1"], "w_rows").where("w_low < low")
    lost = lost.groupBy("d0", "d1").agg(  # windows of one piece
        F.collect_list(F.struct("at", F.lit(1).cast("bigint").alias("windows"))).alias("parts"))
    held = branching.select("d0", "d1", "low", "rows").join(lost, ["d0", "d1"])
    marks = cut(marks.unionByName(held.withColumn("whole", F.lit(False))), "substring-marks")

    met = heavy_join(places.select("row", "id", "d0", "d1", "start"), marks, ["d0", "d1"], "rows")
    met = met.where(F.when(F.col("whole"), F.col("id") > F.col("low")).otherwise(F.col("id") == F.col("low")))
    spans = cut(met.select("row", "start", F.explode("parts").alias("part")).select(
        "row", (F.col("start") + F.col("part.at")).alias("start"), F.col("part.windows").alias("windows"))
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "windows"))).alias("spans")), "substring-spans")
    with small_batches(spark):
        changed = cut(maybe_in(docs.select("row", "text"), spans).join(spans, "row").select("row", "text", "spans")
                      .mapInArrow(_without(span), "row bigint, n_removed bigint, kept string"), "substring-changed")
    out = docs.select("row", "id", "n_words", "sha").join(changed, "row", "left").join(spans, "row", "left")
    return out.select(F.when(F.col("id") < LARGEST_ID, F.col("id")).alias("doc_id"), "n_words",
                      F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
                      F.coalesce("kept", "sha").alias("kept_sha256"),
                      F.coalesce("spans", F.array().cast("array<struct<start:bigint,windows:bigint>>")).alias("spans"))
