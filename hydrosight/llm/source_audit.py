"""How far the vocabularies of the sources of a language lie apart.

The corpus is indexed in one pass, in memory, as far as memory goes:

1. Each task counts its documents' terms in blocks: for each (language, source) the
   occurrences of a term and the documents that hold it. When a block is full it is
   spilled as runs sorted by term, one for each hash shard of the terms, in chunks of
   ``CHUNK`` postings.
2. A shard's chunks meet in the order of their first term. A heap merges the runs, and
   holds only chunks whose terms have begun and not ended; adjacent postings add up. A
   language keeps a term that ``min_docs`` of its documents hold.
3. Sums over kept terms give every group's and language's smoothed frequencies, in whole
   billionths and exact arithmetic.
4. The distance of two sources is V times the distance of their floors (the frequency
   of a term that a source lacks) plus a correction for each term that one of them
   has. Sources are dealt into blocks; corrections are streamed by pair of blocks
   and part of the vocabulary, so no task holds more than ``BLOCK`` x ``BLOCK`` sums and
   ``TERMS`` terms of two blocks, whatever the number of sources.
5. Terms that a source overuses are ranked, each task keeping its first ``top`` ones
   before groups meet.

Memory: a block of ``max_postings`` postings (or ``LONG_TERMS`` bytes of long terms) in a
task, chunks of the runs at one term, the sources of one term.

Defined cases
    null text, lang, source   the empty string
    text without a term       its group still occurs: floors only
    null or repeated doc_id   ids are not read: each row is a document
    long texts                counted whole; a text is spilled after it, not inside
    ties                      values by the item's UTF-8 bytes
    empty table               empty result
    one source in a language  no pairs
    clashing columns          only the text, language and source columns are read
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrosight.llm.common import cut, parallelism, small_batches

#: postings in a chunk of a run
CHUNK = 2000
#: a block is spilled beyond so many bytes of terms longer than 100 bytes
LONG_TERMS = 64 << 20
#: sources in a block, and terms of a part of the vocabulary
BLOCK, TERMS = 128, 8192
BILLION = 1_000_000_000

#: letters in lower case and all bytes from 0x80 make terms; anything else parts them
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


class Block:
    """The postings of one task since its last spill."""

    def __init__(self):
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.size = self.long = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        group = self.groups.get((lang, source))
        if group is None:
            group = self.groups[lang, source] = (Counter(), Counter())
        count, docs = group
        before = len(count)
        terms = terms_of(text)
        count.update(terms)
        distinct = set(terms)
        docs.update(distinct)
        docs[b""] += 1  # the group occurs, even without terms
        self.size += len(count) - before + 1
        self.long += sum(len(t) for t in distinct if len(t) > 100)

    def runs(self, shards: int):
        """Chunks of the runs, one run a shard, each sorted by term: (shard, terms, postings of each
        term, names of the chunk's groups, group, count and documents of each posting)."""
        names = list(self.groups)
        vocabulary = sorted(set().union(*(docs for _, docs in self.groups.values())))
        rank = {t: i for i, t in enumerate(vocabulary)}
        shard_of = np.fromiter((xxhash.xxh3_64_intdigest(t) % shards for t in vocabulary), np.int64, len(vocabulary))
        parts = []
        for g, (count, docs) in enumerate(self.groups.values()):
            n = len(docs)
            parts.append((np.fromiter(map(rank.__getitem__, docs), np.int64, n), np.full(n, g),
                          np.fromiter(map(count.__getitem__, docs), np.int64, n),
                          np.fromiter(docs.values(), np.int64, n)))
        term, group, count, docs = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((group, term, shard_of[term]))
        term, group, count, docs = (x[order] for x in (term, group, count, docs))
        begins = np.flatnonzero(np.diff(term, prepend=-1))  # a term's postings stay in one chunk
        shard = shard_of[term[begins]]
        sizes = np.diff(begins, append=len(term))
        a = 0
        while a < len(begins):
            z = int(np.searchsorted(begins, begins[a] + CHUNK, "right"))
            z = max(a + 1, min(z - 1 if z < len(begins) else z, int(np.searchsorted(shard, shard[a], "right"))))
            i, j = begins[a], begins[z - 1] + sizes[z - 1]
            used, local = np.unique(group[i:j], return_inverse=True)
            yield (int(shard[a]), [vocabulary[t] for t in term[begins[a:z]].tolist()], sizes[a:z],
                   [names[g] for g in used.tolist()], local, count[i:j], docs[i:j])
            a = z


_CHUNKS = ("shard int, first binary, terms array<binary>, sizes array<int>, langs array<string>, "
           "sources array<string>, groups array<int>, counts array<bigint>, docs array<bigint>")


def _chunk_rows(chunks):
    shard, terms, sizes, names, groups, counts, docs = zip(*chunks)

    def lists(values, dtype):
        ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).astype(dtype)))
    return pa.RecordBatch.from_arrays(
        [pa.array(shard, pa.int32()), pa.array([t[0] for t in terms], pa.binary()), pa.array(terms, pa.list_(pa.binary())),
         lists(sizes, np.int32), pa.array([[x[0] for x in n] for n in names], pa.list_(pa.string())),
         pa.array([[x[1] for x in n] for n in names], pa.list_(pa.string())), lists(groups, np.int32),
         lists(counts, np.int64), lists(docs, np.int64)],
        names=["shard", "first", "terms", "sizes", "langs", "sources", "groups", "counts", "docs"])


def _index(shards: int, max_postings: int):
    def spill(block):
        held = []
        for chunk in block.runs(shards):
            held.append(chunk)
            if len(held) == 64:
                yield _chunk_rows(held)
                held = []
        if held:
            yield _chunk_rows(held)

    def run(batches):
        block = Block()
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                block.add(lang, source, text)
                if block.size >= max_postings or block.long >= LONG_TERMS:
                    yield from spill(block)
                    block = Block()
        if block.groups:
            yield from spill(block)
    return run


class Names:
    """Numbers for the groups and languages that a task has met."""

    def __init__(self):
        self.known: dict[tuple[str, str], int] = {}
        self.langs: list[str] = []
        self.sources: list[str] = []
        self.lang_known: dict[str, int] = {}
        self.lang_of = np.empty(0, np.int64)

    def numbers(self, langs: list[str], sources: list[str]) -> np.ndarray:
        for lang, source in zip(langs, sources):
            if (lang, source) not in self.known:
                self.known[lang, source] = len(self.known)
                self.langs.append(lang)
                self.sources.append(source)
                self.lang_known.setdefault(lang, len(self.lang_known))
        if len(self.lang_of) < len(self.langs):
            new = [self.lang_known[x] for x in self.langs[len(self.lang_of):]]
            self.lang_of = np.concatenate([self.lang_of, new]).astype(np.int64)
        return np.array([self.known[k] for k in zip(langs, sources)], np.int64)


class Chunk:
    """Part of a run: terms in order, the end of each one's postings, and its documents in all."""

    def __init__(self, shard, terms, sizes, groups, counts, docs):
        self.shard, self.terms, self.groups, self.counts, self.docs = shard, terms, groups, counts, docs
        ends = np.concatenate([[0], np.cumsum(sizes)])
        self.ends, self.held = ends.tolist(), np.add.reduceat(docs, ends[:-1]).tolist()

    def postings(self, at: int):
        i, j = self.ends[at], self.ends[at + 1]
        return self.groups[i:j], self.counts[i:j], self.docs[i:j]


def chunks_of(batches, names: Names):
    for batch in batches:
        for i in range(batch.num_rows):
            shard, terms, langs, sources = (batch.column(c)[i].as_py() for c in (0, 2, 4, 5))
            sizes, groups, counts, docs = (batch.column(c)[i].values.to_numpy() for c in (3, 6, 7, 8))
            # copies, so that an open chunk does not hold its batch
            yield Chunk(shard, terms, sizes, names.numbers(langs, sources)[groups], counts.copy(), docs.copy())


def merged(chunks):
    """(term, documents in all, [(chunk, place) of each run]) of sorted runs, in order. ``chunks`` come
    by (shard, first term): one enters the heap when the smallest term there has reached its first."""
    heap: list[tuple] = []
    waiting = next(chunks, None)
    order = 0
    while heap or waiting is not None:
        while waiting is not None and (not heap or (waiting.shard, waiting.terms[0]) <= heap[0][:2]):
            heapq.heappush(heap, (waiting.shard, waiting.terms[0], order, 0, waiting))
            order += 1
            waiting = next(chunks, None)
        shard, term = heap[0][:2]
        found, held = [], 0
        while heap and heap[0][1] == term and heap[0][0] == shard:
            _, _, n, at, chunk = heap[0]
            found.append((chunk, at))
            held += chunk.held[at]
            if at + 1 < len(chunk.terms):
                heapq.heapreplace(heap, (shard, chunk.terms[at + 1], n, at + 1, chunk))
            else:
                heapq.heappop(heap)
        yield term, held, found


def added(found):
    """(groups, counts, documents) of one term, the postings that runs have of a group as one."""
    groups, counts, docs = (np.concatenate(x) for x in zip(*(chunk.postings(at) for chunk, at in found)))
    order = np.argsort(groups, kind="stable")
    groups = groups[order]
    begins = np.flatnonzero(np.diff(groups, prepend=-1))
    return groups[begins], np.add.reduceat(counts[order], begins), np.add.reduceat(docs[order], begins)


_MERGED = "lang string, source string, term binary, n bigint, n_lang bigint"


def _merge(min_docs: int):
    """Sorted chunks -> frequencies of kept terms by group (source) and language (source null); the
    empty term stands for the group itself."""
    def run(batches):
        names = Names()
        held: list[tuple] = []  # (term, groups, counts, count in the language), a language at a time
        rows = 0

        def flush():
            sizes = [len(h[1]) for h in held]
            groups, counts = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            langs, sources = pa.array(names.langs, pa.string()), pa.array(names.sources, pa.string())
            at = np.repeat(np.arange(len(held)), sizes)
            everywhere = np.array([h[3] for h in held], np.int64)
            # the language's own row where the term is one
            own = np.array([i for i, h in enumerate(held) if h[0]], np.int64)
            own_lang = np.array([h[1][0] for h in held if h[0]], np.int64)
            terms = pa.array([h[0] for h in held], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([langs.take(pa.array(groups)), langs.take(pa.array(own_lang))]),
                 pa.concat_arrays([sources.take(pa.array(groups)), pa.nulls(len(own), pa.string())]),
                 pa.concat_arrays([terms.take(pa.array(at)), terms.take(pa.array(own))]),
                 pa.array(np.concatenate([counts, everywhere[own]])),
                 pa.array(np.concatenate([everywhere[at], everywhere[own]]))],
                names=["lang", "source", "term", "n", "n_lang"])
        for term, everywhere, found in merged(chunks_of(batches, names)):
            if term and everywhere < min_docs:  # in all languages together
                continue
            groups, counts, docs = added(found)
            langs = names.lang_of[groups]
            for lang in np.unique(langs).tolist():
                mine = langs == lang
                if not term or docs[mine].sum() >= min_docs:
                    held.append((term, groups[mine], counts[mine], int(counts[mine].sum())))
                    rows += int(mine.sum()) + 1
            if rows >= 100_000:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()
    return run


def frequency(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 v)) in whole numbers: three steps of a thousand, so
    nothing overflows while total + 5 v is under 9 * 10^15."""
    divisor = total + v * 5
    rest, out = n + 5, F.lit(0).cast("bigint")
    for _ in range(3):
        scaled = rest * 1000
        digit = F.call_function("div", scaled, divisor)
        out, rest = out * 1000 + digit, scaled % divisor
    return out + 1


def _corrections(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One pair of source blocks and part of the vocabulary: for each pair of sources the sum, over
    the terms that a source of the two blocks has, of the distance beyond that of their floors; the
    first part adds the distance of the floors for the whole vocabulary. Rows without a term
    name the sources and their floors."""
    lang, left, right, part = (k.as_py() for k in key)
    known = table.filter(pa.compute.is_null(table["term"]))
    names = known["source"].to_pylist()
    floors, blocks = known["p"].to_numpy(), known["block"].to_numpy()
    posted = table.filter(pa.compute.is_valid(table["term"]))
    term = posted["term"].combine_chunks().dictionary_encode()
    t = term.indices.to_numpy(zero_copy_only=False)
    s = pa.compute.index_in(posted["source"], pa.array(names, pa.string())).to_numpy()
    p = posted["p"].to_numpy()
    order = np.argsort(t, kind="stable")
    t, s, p = t[order], s[order], p[order]
    rows, cols = np.flatnonzero(blocks == left), np.flatnonzero(blocks == right)
    apart = np.abs(floors[rows][:, None] - floors[cols][None, :])
    n_terms = len(term.dictionary)
    sums = apart * ((int(known["v"][0].as_py()) if part == 0 else 0) - n_terms)
    step = max(1, (1 << 20) // len(names))
    for a in range(0, n_terms, step):
        i, j = np.searchsorted(t, [a, a + step])
        dense = np.tile(floors, (min(step, n_terms - a), 1))
        dense[t[i:j] - a, s[i:j]] = p[i:j]
        for x, r in enumerate(rows):
            sums[x] += np.abs(dense[:, [r]] - dense[:, cols]).sum(axis=0)
    out = []
    for x, r in enumerate(rows.tolist()):
        for y, c in enumerate(cols.tolist()):
            if left != right or r < c:
                value = int(sums[x, y])
                out += [(names[r], names[c], value), (names[c], names[r], value)]
    a, b, values = zip(*out) if out else ([], [], [])
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(a, pa.string()),
                     "item": pa.array(b, pa.string()), "more": pa.array(values, pa.int64())})


def source_audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                 min_docs: int = 30, top: int = 50, max_postings: int = 400_000, shards: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has the distance of every other source of
    the language, part ``term`` the ``top`` terms that the source uses more than its language does."""
    spark = df.sparkSession
    shards = shards or parallelism(spark)

    def known(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(known(lang_col).alias("lang"), known(source_col).alias("source"),
                     known(text_col).cast("binary").alias("text"))
    with small_batches(spark):
        runs = cut(rows.mapInArrow(_index(shards, max_postings), _CHUNKS), "audit-runs")
    with small_batches(spark, 4):
        postings = cut(runs.repartitionById(shards, "shard").sortWithinPartitions("shard", "first")
                       .mapInArrow(_merge(min_docs), _MERGED), "audit-postings")
    langs = postings.where("source is null").groupBy("lang").agg(F.sum("n").alias("lang_total"),
                                                                 F.count(F.lit(1)).alias("v"))
    groups = postings.where("source is not null").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    none = F.lit(0).cast("bigint")
    groups = groups.join(sizes, "lang").join(langs, "lang", "left").select(
        "lang", "source", "total", F.coalesce("lang_total", none).alias("lang_total"),
        F.coalesce("v", none).alias("v"),
        F.ceil(F.col("n_sources") / BLOCK).cast("int").alias("n_blocks"))
    groups = cut(groups.select(
        "*", F.pmod(F.xxhash64("source"), F.col("n_blocks")).cast("int").alias("block"),
        F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).cast("int").alias("n_parts"),
        F.when(F.col("v") > 0, frequency(none, F.col("total"), F.col("v"))).otherwise(0).alias("floor")), "audit-groups")
    used = cut(postings.where("source is not null and octet_length(term) > 0")
               .join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").cast("string").alias("term"), "v", "block", "n_blocks", "n_parts",
        frequency(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        frequency(F.col("n_lang"), F.col("lang_total"), F.col("v")).alias("q")), "audit-used")

    others = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    terms = used.select("lang", "source", "term", "p", "v", "block", others,
                        F.pmod(F.xxhash64("term"), F.col("n_parts")).cast("int").alias("part"))
    floors = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("floor").alias("p"), "v",
                           "block", "n_parts", others)
    floors = floors.select(*floors.columns, F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part")).drop("n_parts")
    blocks = terms.unionByName(floors).select(
        "lang", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "part",
        "source", "term", "p", "v", "block")
    pairs = blocks.groupBy("lang", "left", "right", "part").applyInArrow(
        _corrections, "lang string, source string, item string, more bigint")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("more").alias("value"))
    over = used.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    first = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [part.select("lang", "source", F.lit(name).alias("part"), "item", "value", first.alias("rank"))
              for name, part in (("pair", pairs), ("term", over))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
