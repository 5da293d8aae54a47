"""Jaccard self-join of documents' word n-grams: a size-aware heavy-light join.

A document's set holds the 64-bit hashes of its distinct 5-word shingles
(A-Z in lower case; the whole sequence when it is shorter). Equal sets are one set, by a 64-bit
digest. Sets link when 100 * intersection >= ``percent`` * union.

1. A first scan gives each document its set's size and digest, and counts
   shingles by 24 bits of their hash (a counter array of fixed size; parts of it are added up
   in Spark). The counts order all shingles: those that do not stand out first, by hash among equals.
2. A set of n links only with sets that share o = ceil(percent * n / 100) of its
   shingles, so two linked sets share one of their first n - o + 1 and two of their
   first n - o + 2. *Light* sets (n <= boundary) list themselves under every subset
   of two of the latter, heavy ones under each of the former; light sets that are
   large enough for a heavy partner also under each of the former. The boundary has the
   least cost by the histogram of sizes: subsets to enumerate against
   list entries to scan.
3. Entries travel as packed arrays by hash range of their key. A list of up to
   ``SHORT`` sets gives its pairs; in a longer one a leader (smallest by hash) is paired with
   the others. Only sizes and positions that allow a link are paired: what two sets have before
   their first common shingle they do not share, and copies that were edited a lot
   have their own, rare shingles first. Lists of very frequent shingles are salted into parts.
4. A parity bitmap of about n bits, made in the first scan, bounds the difference of two
   sets from below, which drops nearly all pairs that merely share a passage. The rest are
   verified on the whole sets, which another scan makes for their members only (found by a
   Bloom filter of bounded size, confirmed by the join). Links become components. Long
   lists that still hold several components elect other leaders, and then all their remaining
   pairs from different components go the same way. Pairs inside a component need
   no test, so a group of copies costs its size, not its square.

Defined cases
    null or empty text, no words   size 0, linked with nothing
    null doc_id          takes part; its component is the smallest id in reach, or null
    repeated rows        equal sets, one component
    very long text       whole
    empty table          empty result
    clashing columns     only the id and text columns are read
"""

from __future__ import annotations

import posixpath
import zlib
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrosight.llm.common import arrow_fs, bound_batches, cut, parallelism, scratch_files
from hydrosight.llm.components import components

WORDS = 5
COUNTERS = 24  # bits
PARTS = 256
FOLD = 512  # bits
#: entries a task holds before it writes them out
FLUSH = 100_000
LIGHT_MOST = 64  # largest boundary that is considered
SHORT = 32  # lists of up to so many sets are paired at once
LARGE = 65535  # sizes and positions from here on are not told apart by the filters
LEADERS = 12  # other leaders of a longer list
ORDER_FROM = 4  # classes of frequency are log2(count) less this
SALTED = 16

_K, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)  # odd constants of a mixing function


#: a 64-bit value for each byte, A-Z as a-z; which bytes are white space
_BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: an odd value for each place in a word; longer words are hashed by themselves
_PLACES = np.random.default_rng(21).integers(0, 1 << 63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word: sums of byte values times independent values of their places. (Powers of one
    number in their stead collide, modulo 2^64, for words that alternate as Thue-Morse sequences do.)"""
    b = np.frombuffer(text, np.uint8)
    space = np.concatenate([[True], _SPACE[b], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    if not len(edges):
        return np.zeros(0, np.uint64)
    start, end = edges[::2], edges[1::2]
    place = np.arange(start[0], len(b) + 1) - np.repeat(start, np.diff(start, append=len(b) + 1))
    values = np.zeros(len(b) + 1, np.uint64)
    values[start[0]:-1] = _BYTES[b[start[0]:]] * _PLACES[place[:-1] & (len(_PLACES) - 1)]
    h = np.add.reduceat(values, edges)[::2]
    for i in np.flatnonzero(end - start > len(_PLACES)):
        h[i] = xxhash.xxh3_64_intdigest(text[start[i]:end[i]].lower())
    h *= _M
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    w = word_hashes(text or b"")
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(n, WORDS)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j:n - k + 1 + j]) * _K
        h ^= h >> np.uint64(29)
    h *= _M
    h ^= h >> np.uint64(32)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the shingles by the low bits of their hash, 64 bits at least and
    about one a shingle: two sets differ in as many shingles as their bitmaps in bits, at least."""
    size = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(s: np.ndarray) -> list[int]:
    """The parities of ``FOLD`` bits as 64-bit numbers, for expressions."""
    odd = np.bincount((s & np.uint64(FOLD - 1)).astype(np.int64), minlength=FOLD) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def may_link(x: bytes, m: int, y: bytes, n: int, percent: int) -> bool:
    """False only if the bitmaps show that sets of m and n are too different."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    p, q = 8 * len(x), 8 * len(y)
    while p > q:  # fold to the smaller: parities by one bit less add up
        p //= 2
        a = (a >> p) ^ (a & ((1 << p) - 1))
    while q > p:
        q //= 2
        b = (b >> q) ^ (b & ((1 << q) - 1))
    differ = (a ^ b).bit_count()
    both = (m + n - differ) // 2  # no larger intersection is possible
    return 100 * both >= percent * (m + n - both)


def needed(n, percent: int):
    """The shingles that a partner of a set of n must share."""
    return -(-n * percent // 100)


# --- first scan --------------------------------------------------------------------------------

def _describe(batches):
    counts, seen = np.zeros(1 << COUNTERS, np.uint16), set()
    for batch in batches:
        ns, sids, maps, bits = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text)
            d = digest(s)
            ns.append(len(s))
            sids.append(d)
            maps.append(None if d in seen else bitmap(s))
            bits.append(None if d in seen else folded(s))
            if d not in seen:
                seen.add(d)
                at = (s >> np.uint64(64 - COUNTERS)).astype(np.int64)
                counts[at] += counts[at] < 65535
        m = len(ns)
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * m, pa.int32()), batch.column(0), pa.array(ns, pa.int64()), pa.array(sids, pa.int64()),
             pa.array(maps, pa.binary()), pa.array(bits, pa.list_(pa.int64()))],
            names=["kind", "doc_id", "n", "sid", "map", "bits"])
    rows = [(i, zlib.compress(part.tobytes(), 1)) for i, part in enumerate(counts.reshape(PARTS, -1)) if part.any()]
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([1] * len(rows), pa.int32()), pa.nulls(len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
             pa.nulls(len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
             pa.nulls(len(rows), pa.list_(pa.int64()))], names=["kind", "doc_id", "n", "sid", "map", "bits"])


def _order(least: int):
    """Adds up the counters of a partition's parts; classes of those of ``least`` or more."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(data), np.uint16)
                sums[part] = sums[part] + x if part in sums else x.astype(np.int64)
        for part, x in sums.items():
            often = x >= least
            cls = np.where(often, np.maximum(np.log2(np.maximum(x, 1)).astype(np.int64) - ORDER_FROM, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([cls.astype(np.uint8).tobytes()], pa.binary()),
                 pa.array([float((x[often].astype(np.float64) ** 2).sum())])], names=["part", "classes", "mass"])
    return run


def boundary(sizes: dict[int, int], scan: float, percent: int) -> int:
    """The largest light size at the least cost. A subset key costs one entry; a
    single key one entry and ``scan`` entries to read in its list."""
    def cost(x):
        total = 0.0
        for n, m in sizes.items():
            o = needed(n, percent)
            if 2 < n <= x:
                total += m * comb(n - o + 2, 2)
            if n > x or needed(x + 1, percent) <= n:
                total += m * (n - o + 1) * (1 + scan)
        return total
    return min(range(2, LIGHT_MOST + 1), key=cost)


# --- second scan -------------------------------------------------------------------------------

def _keys(s: np.ndarray, frequent: np.ndarray, light: int, percent: int):
    """A set's lists: shingles with their class and position in the order, then
    subsets of two (class and position 0)."""
    n, none = len(s), np.zeros(0, np.uint64)
    if n <= (2 if percent > 66 else 1):  # linked with equal sets only
        return none, none.astype(np.uint8), none.astype(np.int64), none
    o = needed(n, percent)
    cls = frequent[(s >> np.uint64(64 - COUNTERS)).astype(np.int64)]
    order = np.argsort(cls, kind="stable") if cls.any() else np.arange(n)
    first = order[:n - o + 2]
    pairs = none
    if n <= light:
        f = s[first]
        i, j = np.triu_indices(len(f), 1)
        a, b = np.minimum(f[i], f[j]), np.maximum(f[i], f[j])
        pairs = ((a ^ (b * _K)) * _M) ^ (b >> np.uint64(31))
    if n <= light and n < needed(light + 1, percent):
        return none, none.astype(np.uint8), none.astype(np.int64), pairs
    single = first[:n - o + 1]
    return s[single], cls[single], np.arange(len(single)), pairs


def may_overlap(m, i, n, j, percent: int):
    """False only if sets of m and n, whose first common shingle stands at i
    and j of their order, are too different: what stands before is not shared."""
    most = np.minimum(m - i, n - j)
    return (np.maximum(m, n) >= LARGE) | ((100 + percent) * most >= percent * (m + n))


def _entries(path: str, light: int, percent: int, ranges: int):
    def run(batches):
        frequent, seen = _load(path, 1 << COUNTERS), set()
        held: list[tuple] = []
        count = 0

        def flush():
            key, cls, pos = (np.concatenate([h[k] for h in held]) for k in range(3))
            lens = [len(h[0]) for h in held]
            sid = np.repeat(np.array([h[3] for h in held], np.int64), lens)
            n = np.repeat(np.array([min(h[4], LARGE) for h in held], np.uint16), lens)
            # the list of a shingle in over 2^SALTED sets is cut into parts by its sets
            parts = np.uint64(1) << np.clip(cls.astype(np.int64) + ORDER_FROM - SALTED, 0, 15).astype(np.uint64)
            salt = np.where(parts > 1, sid.astype(np.uint64) % parts + np.uint64(1), np.uint64(0))
            mixed = key * _M
            mixed ^= mixed >> np.uint64(32)
            # 40 bits tell the lists of a range apart
            part = (((mixed ^ (salt * _K)) >> np.uint64(40)) % np.uint64(ranges)).astype(np.int64)
            short, tag = (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32), (mixed >> np.uint64(32)).astype(np.uint8)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(ranges + 1))
            rows = [[], [], [], [], [], [], []]
            columns = (short, tag, salt.astype(np.uint16), sid, n, np.minimum(pos, LARGE).astype(np.uint16))
            for p in range(ranges):
                at = order[edges[p]:edges[p + 1]]
                if len(at):
                    for col, x in zip(rows, (p, *(c[at].tobytes() for c in columns))):
                        col.append(x)
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])],
                names=["part", "key", "tag", "salt", "sid", "n", "pos"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingles(text)
                d = digest(s)
                if d in seen:
                    continue
                seen.add(d)
                single, cls, pos, pairs = _keys(s, frequent, light, percent)
                # the lowest bit tells lists of subsets from lists of shingles
                key = np.concatenate([single | np.uint64(1), pairs & ~np.uint64(1)])
                if len(key):
                    none = np.zeros(len(pairs), np.int64)
                    held.append((key, np.concatenate([cls, none]), np.concatenate([pos, none]), d, len(s)))
                    count += len(key)
                if count >= max(FLUSH, 512 * ranges):
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()
    return run


def _priority(sid: np.ndarray) -> np.ndarray:
    x = sid.astype(np.uint64) * _K
    return x ^ (x >> np.uint64(31))


def _lists(percent: int):
    """Pairs (key null; leader, sid) of short lists; leader and members of long ones."""
    kinds = (np.uint32, np.uint8, np.uint16, np.int64, np.uint16, np.uint16)

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for p, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(p, []).append([np.frombuffer(b, t) for b, t in zip(blobs, kinds)])
        for p in list(held):
            key, tag, salt, sid, n, pos = (np.concatenate(c) for c in zip(*held.pop(p)))
            key = key.astype(np.int64) << 8 | tag
            order = np.lexsort((pos, sid, salt, key))
            key, salt, sid = key[order], salt[order], sid[order]
            n, pos = n[order].astype(np.int64), pos[order].astype(np.int64)
            fresh = np.ones(len(key), bool)  # an equal set from another task
            fresh[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (sid[1:] != sid[:-1])
            key, salt, sid, n, pos = key[fresh], salt[fresh], sid[fresh], n[fresh], pos[fresh]
            start = np.ones(len(key), bool)
            start[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
            lists = np.cumsum(start) - 1
            size = np.bincount(lists)[lists] if len(lists) else lists
            out = []
            short = np.flatnonzero((size > 1) & (size <= SHORT) & (salt == 0))
            found = []
            for step in range(1, SHORT if len(short) else 1):
                i = short[short + step < len(lists)]
                i = i[lists[i] == lists[i + step]]
                j = i + step
                ok = may_overlap(n[i], pos[i], n[j], pos[j], percent)
                ok &= np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent
                found.append(np.stack([sid[i[ok]], sid[j[ok]]], axis=1))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                zero = np.zeros(len(pairs), np.int64)
                out.append((pa.nulls(len(pairs), pa.int64()), pairs[:, 1], zero, zero, pairs[:, 0]))
            long = (size > SHORT) | (salt > 0)
            if long.any():
                key, salt, sid, n, pos, lists = (x[long] for x in (key, salt, sid, n, pos, lists))
                order = np.lexsort((_priority(sid), lists))
                key, salt, sid, n, pos, lists = (x[order] for x in (key, salt, sid, n, pos, lists))
                at = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
                sizes = np.diff(np.append(at, len(lists)))
                # lists of equal members are one list, with each member's first position
                marks = np.stack([sizes.astype(np.uint64), np.add.reduceat(_priority(sid) * _M, at),
                                  np.bitwise_xor.reduceat(_priority(sid), at),
                                  np.where(salt[at] > 0, key[at], 0).astype(np.uint64)], axis=1)
                _, one, group = np.unique(marks, axis=0, return_index=True, return_inverse=True)
                place = np.repeat(at[one][group.ravel()] - at, sizes) + np.arange(len(lists))
                np.minimum.at(pos, place, pos.copy())
                keep = np.zeros(len(lists), bool)
                keep[place] = True
                first = np.repeat(at, sizes)
                # the parts of a salted key are one list again
                full = np.where(salt > 0, np.int64(1) << 62 | key, np.int64(p) << 40 | key)
                out.append((pa.array(full[keep]), sid[keep], n[keep], pos[keep], sid[first][keep]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([o[0] for o in out]),
                     *(pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in range(1, 5))],
                    names=["key", "sid", "n", "pos", "leader"])
    return run


def _similar(percent: int):
    def run(batches):
        for batch in batches:
            m = pa.array([may_link(x, p, y, q, percent) for x, p, y, q in
                          zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(m), batch.column(1).filter(m)], names=["a", "b"])
    return run


# --- bounded tables in the shared folder -----------------------------------------------------------

_loaded: dict[str, np.ndarray] = {}


def _load(path: str, size: int) -> np.ndarray:
    """An array of (index, value) or (part, values) rows of a Parquet folder, read once
    by each Python worker."""
    if path not in _loaded:
        _loaded.clear()  # one table at a time
        fs, root = arrow_fs(path)
        out = np.zeros(size, np.uint8)
        for f in fs.get_file_info(pafs.FileSelector(root)):
            if posixpath.basename(f.path).startswith("part-"):
                t = pq.read_table(f.path, filesystem=fs)
                if pa.types.is_binary(t.schema.field(1).type):  # parts of equal length
                    for part, data in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                        out[part * len(data):(part + 1) * len(data)] = np.frombuffer(data, np.uint8)
                else:
                    out[t.column(0).to_numpy()] |= t.column(1).to_numpy().astype(np.uint8)
        _loaded[path] = out
    return _loaded[path]


def _bits(sid: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    x = _priority(sid)
    m = np.uint64(size * 8 - 1)
    return x & m, (x >> np.uint64(30)) & m


def _bloom(size: int):
    """(byte, bits) of the sets' places in the filter; a task holds a bit for each."""
    def run(batches):
        out = np.zeros(size, np.uint8)
        for batch in batches:
            for b in _bits(batch.column(0).to_numpy(), size):
                np.bitwise_or.at(out, (b >> np.uint64(3)).astype(np.int64),
                                 np.uint8(1) << (b & np.uint64(7)).astype(np.uint8))
        at = np.flatnonzero(out)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out[at].astype(np.int32))],
                                             names=["at", "bits"])
    return run


# --- third scan and verification ----------------------------------------------------------------------

def _sets(path: str, size: int):
    def run(batches):
        bloom, seen = _load(path, size), set()
        for batch in batches:
            sids, sets = [], []
            for text in batch.column(0).to_pylist():
                s = shingles(text)
                d = digest(s)
                if d in seen:
                    continue
                seen.add(d)
                a, b = (x[0] for x in _bits(np.array([d], np.int64), size))
                if all(bloom[int(x) >> 3] >> (int(x) & 7) & 1 for x in (a, b)):
                    sids.append(d)
                    sets.append(s.tobytes())
            if sids:
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sets, pa.binary())],
                                                 names=["sid", "items"])
    return run


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(m), batch.column(1).filter(m)], names=["a", "b"])
    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. The side that a leader dominates is joined
    last; AQE splits it."""
    one = sets.select(F.col("sid").alias("b"), F.col("items").alias("y"))
    two = sets.select(F.col("sid").alias("a"), F.col("items").alias("x"))
    both = pairs.join(one, "b").join(two, "a").select("a", "b", "x", "y")
    return both.mapInArrow(_verified(percent), "a bigint, b bigint")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75,
                       filter_mb: int = 64) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id. ``percent`` from 51 to 100:
    linked sets of two shingles and more then share two, a set of one equals its partner."""
    if not 50 < percent <= 100:
        raise ValueError(f"percent must be 51 to 100, not {percent}")
    spark = df.sparkSession
    bound_batches(spark)
    text = F.col(text_col).cast("string").cast("binary")
    described = cut(df.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
                    .mapInArrow(_describe, "kind int, doc_id bigint, n bigint, sid bigint, map binary, bits array<bigint>"), "shingle-sets", "kind")
    docs = described.where("kind = 0").select("doc_id", "n", "sid")
    distinct = cut(described.where("kind = 0 and map is not null").select("sid", "n", "map", "bits").dropDuplicates(["sid"]),
                   "shingle-distinct")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    # shingles that stand out of what a counter holds by chance
    mean = total / (1 << COUNTERS)
    path = scratch_files(spark, "shingle-order")
    (described.where("kind = 1").select("n", "map").repartition(parallelism(spark), "n")
     .mapInArrow(_order(int(mean + 6 * mean ** 0.5 + 4)), "part bigint, classes binary, mass double").write.parquet(path))
    mass = spark.read.schema("part bigint, classes binary, mass double").parquet(path).agg(F.sum("mass")).first()[0] or 0.0
    sizes = {r["n"]: r["m"] for r in distinct.where(F.col("n").between(3, LIGHT_MOST * 4))
             .groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()}
    light = boundary(sizes, min(16.0, mass / max(1, total)), percent)

    ranges = 2 * parallelism(spark)
    entries = df.select(text.alias("text")).mapInArrow(
        _entries(path, light, percent, ranges),
        "part int, key binary, tag binary, salt binary, sid binary, n binary, pos binary")
    lists = cut(entries.repartition(parallelism(spark), "part").mapInArrow(
        _lists(percent), "key bigint, sid bigint, n bigint, pos bigint, leader bigint"), "shingle-lists")

    def allowed(m, n):
        return F.least(m, n) * 100 >= F.greatest(m, n) * percent

    def ordered(pairs):
        return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def promising(pairs):
        """Pairs that sizes and bitmaps allow to link."""
        one = distinct.select(F.col("sid").alias("a"), F.col("map").alias("x"), F.col("n").alias("p"))
        two = distinct.select(F.col("sid").alias("b"), F.col("map").alias("y"), F.col("n").alias("q"))
        both = (pairs.join(one, "a").join(two, "b").where(allowed(F.col("p"), F.col("q")))
                .select("a", "b", "x", "p", "y", "q"))
        return cut(both.mapInArrow(_similar(percent), "a bigint, b bigint"), "shingle-pairs")

    made: list[DataFrame] = []

    def linked(pairs):
        """The pairs that link. Sets that no earlier turn made are made now."""
        listed = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
        for sets in made:
            listed = listed.join(sets.select("sid"), "sid", "left_anti")
        listed = cut(listed, "shingle-listed")
        n = listed.count()
        if n:
            size = 1 << max(10, min((filter_mb << 20).bit_length() - 1, (2 * n).bit_length()))
            bloom = scratch_files(spark, "shingle-filter")
            (listed.mapInArrow(_bloom(size), "at bigint, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits"))
             .write.parquet(bloom))
            sets = df.select(text.alias("text")).mapInArrow(_sets(bloom, size), "sid bigint, items binary")
            # tasks may find the same set; any copy serves
            made.append(cut(sets.join(listed.hint("shuffle_hash"), "sid", "left_semi").dropDuplicates(["sid"]),
                            "shingle-items"))
        sets = made[0]
        for more in made[1:]:
            sets = sets.union(more)
        return cut(_verify(pairs, sets, percent), "shingle-links")

    def overlapping(m, i, n, j):
        """``may_overlap`` and sizes, as an expression."""
        most = F.least(m - i, n - j)
        return (F.greatest(m, n) >= LARGE) | (allowed(m, n) & (most * (100 + percent) >= (m + n) * percent))

    def alike(m, x, n, y):
        """What the folded bitmaps allow, as an expression."""
        differ = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(FOLD // 64)), F.lit(0))
        return (F.greatest(m, n) >= LARGE) | ((m + n - differ) * (100 + percent) >= (m + n) * (2 * percent))

    long = lists.where("key is not null").select("key", "sid", "n", "pos").join(
        distinct.select("sid", "bits"), "sid")
    first = lists.where("key is not null and sid = leader").select("key", "leader", F.col("n").alias("m"),
                                                                   F.col("pos").alias("i"))
    stars = lists.where("key is not null and sid <> leader").join(first, ["key", "leader"]).where(
        overlapping(F.col("n"), F.col("pos"), F.col("m"), F.col("i")))
    pairs = lists.where("key is null").select("leader", "sid").union(stars.select("leader", "sid"))
    near = promising(ordered(pairs.select(F.col("leader").alias("a"), F.col("sid").alias("b"))))
    if near.isEmpty():
        links = near
    else:
        links = linked(near)
    labels = components(links)
    for last in (False, True):
        open_ = cut(long.join(labels.select(F.col("id").alias("sid"), "label"), "sid", "left").select(
            "key", "sid", "n", "pos", "bits", F.coalesce("label", "sid").alias("label")), "shingle-open")
        # a table of its own: AQE can split a long list in the joins below
        several = cut(open_.groupBy("key").agg(
            F.min("label").alias("lo"), F.max("label").alias("hi"),
            *(F.min_by(F.struct("sid", "n", "pos", "bits", "label"), F.xxhash64("sid", F.lit(k))).alias(f"lead{k}") for k in range(LEADERS)))
            .where("lo <> hi").drop("lo", "hi"), "shingle-several")
        if several.isEmpty():
            break
        if not last:  # other leaders against the members of other components
            lead = several.select("key", F.explode(F.array(*(f"lead{k}" for k in range(LEADERS)))).alias("lead")).distinct()
            pairs = (open_.join(lead, "key").where((F.col("label") != F.col("lead.label"))
                                                       & overlapping(F.col("n"), F.col("pos"), F.col("lead.n"),
                                                                     F.col("lead.pos"))
                                                       & alike(F.col("n"), F.col("bits"), F.col("lead.n"), F.col("lead.bits")))
                     .select(F.col("lead.sid").alias("a"), F.col("sid").alias("b")))
        else:  # all that is left: members outside a list's largest component against the others
            inside = open_.join(several.select("key"), "key")
            main = cut(inside.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
                       .groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("main")), "shingle-main")
            # a pair that several lists hold is taken from the first of them by the position of one side
            inside = inside.join(main, "key")
            mine = inside.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("mine"))
            inside = cut(inside.join(mine, "sid"), "shingle-inside")
            here = F.struct("pos", "key")
            before = F.transform(F.filter("mine", lambda x: (x < here) & (x["pos"] < LARGE)), lambda x: x["key"])
            out = inside.where("label <> main").select("key", F.col("sid").alias("a"), F.col("n").alias("an"),
                                                       F.col("pos").alias("ap"), F.col("label").alias("al"),
                                                       F.col("bits").alias("abits"), before.alias("before"))
            inside = inside.select("key", "sid", "n", "pos", "bits", "label", "main", F.transform("mine", lambda x: x["key"]).alias("keys"))
            pairs = (inside.join(out, "key").where(
                (F.col("label") != F.col("al")) & ((F.col("label") == F.col("main")) | (F.col("a") < F.col("sid")))
                & overlapping(F.col("n"), F.col("pos"), F.col("an"), F.col("ap"))
                & alike(F.col("n"), F.col("bits"), F.col("an"), F.col("abits"))
                & ~F.arrays_overlap("before", "keys")).select("a", F.col("sid").alias("b")))
        more = promising(ordered(pairs).join(near, ["a", "b"], "left_anti"))
        if more.isEmpty():
            continue
        near = near.union(more)
        found = linked(more)
        if not found.isEmpty():
            links = cut(links.union(found), "shingle-links")
            labels = components(links)
    marked = cut(docs.join(labels.select(F.col("id").alias("sid"), "label"), "sid", "left").select(
        "doc_id", "n", F.coalesce("label", "sid").alias("label")), "shingle-labels")
    least = cut(marked.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least")), "shingle-least")
    return marked.join(least, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
