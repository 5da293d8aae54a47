"""Line de-duplication with two Bloom filters.

A line's key is the line without white space at its ends, A-Z in lower case.
Keys of at least ``min_chars`` code points that ``min_docs`` documents hold lose
all their lines but those of the largest doc_id that holds them.

1. Each task hashes the keys of its documents (each key once a document) and
   writes the hashes by segment: 8 bytes a line, after dropping repeats inside
   the task. Their count sizes the filters.
2. The hashes of a segment meet in one task that streams them through two
   filters: once-seen, and twice-seen for hashes that the first already holds.
   A filter has ``bits_per_key`` bits a key, at most ``max_filter_mb``; a fuller
   filter only suspects more lines.
3. A second scan looks the lines up in the twice-seen filter, which the tasks
   read from the shared folder. Documents without a suspected line are done. Of
   the others, (row, 16-byte digest of the key) is shuffled, counted exactly, and
   the confirmed keys decide which lines go. Only those documents' texts move.

Defined cases
    null or empty text   one empty line; the result is the empty text
    null doc_id          a document of its own that any id outranks
    repeated rows        each row is a document; rows of the keeping id all keep
    long lines           taken whole
    empty table          empty result
    clashing columns     n_lines and n_dropped of the input are replaced; other
                         columns pass through untouched
"""

from __future__ import annotations

import hashlib
import posixpath

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrosight.llm.common import WS_BYTES, arrow_fs, bound_batches, cut, parallelism, scratch_files

SEGMENTS = 256
#: hashes a task holds before it writes them out
FLUSH = 1_000_000


def line_keys(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """The key of each line, or None where the key is too short."""
    out = []
    for line in (text or b"").split(b"\n"):
        k = line.strip(WS_BYTES).lower()
        n = len(k)
        out.append(k if n >= min_chars and (n >= 4 * min_chars
                                            or len(k.decode("utf-8", "replace")) >= min_chars) else None)
    return out


def _positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions inside the hash's segment."""
    m = np.uint64(bits - 1)
    return (h >> np.uint64(8)) & m, (h >> np.uint64(34)) & m


def _hashes(min_chars: int):
    def run(batches):
        held, n = [], 0

        def flush():
            h, counts = np.unique(np.array(held, dtype=np.uint64), return_counts=True)
            seg = (h & np.uint64(SEGMENTS - 1)).astype(np.int64)
            order = np.argsort(seg, kind="stable")
            h, counts, seg = h[order], counts[order], seg[order]
            edges = np.searchsorted(seg, np.arange(SEGMENTS + 1))
            rows = [(s, h[a:b].tobytes(), h[a:b][counts[a:b] > 1].tobytes(), int(b - a))
                    for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()),
                 pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64())],
                names=["segment", "seen", "again", "n"])
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for text in batch.column(0).to_pylist():
                keys = {k for k in line_keys(text, min_chars) if k is not None}
                held.extend(map(digest, keys))
                if len(held) >= FLUSH:
                    yield flush()
                    held.clear()
        if held:
            yield flush()
    return run


def _merge(bits: int):
    """Streams the hash lists of a partition's segments through the two filters."""
    def run(batches):
        filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for seg, seen, again in zip(*(batch.column(i).to_pylist() for i in range(3))):
                once, twice = filters.setdefault(seg, (np.zeros(bits, bool), np.zeros(bits, bool)))
                h = np.frombuffer(seen, np.uint64)
                a, b = _positions(h, bits)
                hit = once[a] & once[b]
                twice[a[hit]] = twice[b[hit]] = True
                once[a] = once[b] = True
                a, b = _positions(np.frombuffer(again, np.uint64), bits)
                twice[a] = twice[b] = True
        for seg, (_, twice) in filters.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([seg], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())],
                names=["segment", "twice"])
    return run


_loaded: dict[str, dict[int, np.ndarray]] = {}


def _filter(path: str) -> dict[int, np.ndarray]:
    """The twice-seen filter, read once by each Python worker."""
    if path not in _loaded:
        _loaded.clear()
        fs, root = arrow_fs(path)
        parts = [f.path for f in fs.get_file_info(pafs.FileSelector(root))
                 if posixpath.basename(f.path).startswith("part-")]
        segs = {}
        for p in parts:
            t = pq.read_table(p, filesystem=fs)
            for s, x in zip(t.column(0).to_pylist(), t.column(1)):
                segs[s] = np.frombuffer(x.as_buffer(), np.uint8)
        _loaded[path] = segs
    return _loaded[path]


def _is_set(bits: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Bits in the order of ``np.packbits``."""
    return (bits[(p >> np.uint64(3)).astype(np.int64)]
            >> (np.uint64(7) - (p & np.uint64(7))).astype(np.uint8)) & 1


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _suspects(path: str, bits: int, min_chars: int, schema: pa.Schema):
    def run(batches):
        from pyspark import TaskContext
        twice = _filter(path)
        nothing = np.zeros(bits // 8, np.uint8)
        part = TaskContext.get().partitionId()
        rid = part << 36
        for batch in batches:
            texts = batch.column(1).to_pylist()
            owner, keys, hashes, lines = [], [], [], []
            for i, text in enumerate(texts):
                ks = line_keys(text, min_chars)
                lines.append(len(ks))
                for k in {k for k in ks if k is not None}:
                    owner.append(i)
                    keys.append(k)
                    hashes.append(xxhash.xxh3_64_intdigest(k))
            found: list[list[bytes]] = [[] for _ in texts]
            if keys:
                h = np.array(hashes, dtype=np.uint64)
                a, b = _positions(h, bits)
                seg = (h & np.uint64(SEGMENTS - 1)).astype(np.int64)
                order = np.argsort(seg, kind="stable")
                edges = np.searchsorted(seg[order], np.arange(SEGMENTS + 1))
                hit = np.zeros(len(h), bool)
                for s in range(SEGMENTS):
                    at = order[edges[s]:edges[s + 1]]
                    if len(at):
                        f = twice.get(s, nothing)
                        hit[at] = (_is_set(f, a[at]) & _is_set(f, b[at])).astype(bool)
                for j in np.flatnonzero(hit):
                    found[owner[j]].append(_digest(keys[j]))
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.arange(rid, rid + n), pa.int64()),
                 pa.array(lines, pa.int64()),
                 pa.array(found, pa.list_(pa.binary())), pa.array([bool(x) for x in found])],
                schema=schema)
            rid += n
    return run


def _without(min_chars: int, schema: pa.Schema):
    """Takes the dropped keys' lines out of the texts."""
    def run(batches):
        for batch in batches:
            texts, dropped = [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                text, n = text or b"", 0
                if gone:
                    gone = set(gone)
                    kept = []
                    for line, k in zip(text.split(b"\n"), line_keys(text, min_chars)):
                        if k is not None and _digest(k) in gone:
                            n += 1
                        else:
                            kept.append(line)
                    text = b"\n".join(kept)
                texts.append(text)
                dropped.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()), batch.column(2),
                 pa.array(dropped, pa.int64())], schema=schema)
    return run


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
               min_docs: int = 5, bits_per_key: int = 12, max_filter_mb: int = 128) -> DataFrame:
    """The input's columns with the text replaced, then n_lines (before) and n_dropped."""
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = df.sparkSession
    bound_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashes = cut(df.select(text.cast("binary").alias("text")).mapInArrow(
        _hashes(min_chars), "segment int, seen binary, again binary, n bigint"), "line-hashes")
    n = hashes.agg(F.sum("n")).first()[0] or 0
    bits = 1 << max(10, int(n * bits_per_key / SEGMENTS).bit_length())  # a segment's bits
    bits = min(bits, 1 << ((max_filter_mb << 23) // SEGMENTS).bit_length() - 1)
    path = scratch_files(spark, "line-filter")
    (hashes.repartition(parallelism(spark), "segment").select("segment", "seen", "again")
     .mapInArrow(_merge(bits), "segment int, twice binary")
     .write.option("compression", "zstd").parquet(path))

    keep = [c for c in df.columns if c not in (text_col, "n_lines", "n_dropped")]
    packed = df.select(F.struct(F.col(id_col).cast("bigint").alias("id"),
                                F.struct(*keep).alias("row")).alias("row"),
                       text.cast("binary").alias("text"))
    schema = T.StructType([*packed.schema.fields, T.StructField("rid", T.LongType()),
                           T.StructField("n_lines", T.LongType()),
                           T.StructField("keys", T.ArrayType(T.BinaryType())),
                           T.StructField("suspect", T.BooleanType())])
    scanned = cut(packed.mapInArrow(_suspects(path, bits, min_chars, to_arrow_schema(schema)), schema),
                  "line-suspects", "suspect")
    suspect = scanned.where("suspect")
    held = suspect.select("rid", F.col("row.id").alias("id"), F.explode("keys").alias("key"))
    # a table of its own: the join's two sides are plain shuffles, and AQE splits a hot key
    confirmed = cut(held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
                    .where(F.col("n") >= min_docs).drop("n"), "line-keys")
    gone = (held.join(confirmed, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
            .groupBy("rid").agg(F.collect_list("key").alias("gone")))
    fields = T.StructType([packed.schema["row"], T.StructField("text", T.BinaryType()),
                           T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType())])
    rebuilt = (suspect.join(gone.hint("shuffle_hash"), "rid", "left")
               .select("row", "text", "n_lines", "gone")
               .mapInArrow(_without(min_chars, to_arrow_schema(fields)), fields))
    clean = scanned.where(~F.col("suspect")).select("row", "text", "n_lines",
                                                    F.lit(0).cast("bigint").alias("n_dropped"))
    return clean.unionByName(rebuilt).select(
        *(F.col("text").cast("string").alias(c) if c == text_col else F.col("row.row")[c].alias(c)
          for c in df.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")
