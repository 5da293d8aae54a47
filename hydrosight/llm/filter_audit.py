"""Filter interaction audit by truth-table survival words.

Five filters decide about each document: four by its text alone, the fifth drops
repeats of a text. A document's word has one bit for each of the 32 subsets of the
filters; the bit is set when the document survives that subset. How many documents
survive a subset is then a positional popcount of the words, and every figure of
every order in which the filters may run follows from those 32 counts a part and label.

1. One scan hashes each text and tests the four text filters (bytes, no decoding).
2. Labels join by id. Rows with equal text, part and labels become one row with a
   count before the texts' smallest ids are compared, so a text that a third of all
   documents share leaves each task as a few rows.
3. Each task adds the words of its rows by carry-save adders: three words of weight
   2^k become a sum of weight 2^k and a carry of weight 2^(k+1), on whole arrays,
   until two words a weight are left to count. A row that stands for n documents
   enters at the weights of the bits of n. 32 counts a part and label leave a task.
4. The counts are summed, and each part's are read off for all orders.

Memory: a task holds one batch of texts, then 40 bytes a row of a batch, and 32
counts a part and label (written out past ``MAX_PARTS`` of them).

Defined cases
    null text            the empty text (no words: under the length limit, nothing else)
    null part            the empty string
    null doc_id          larger than any id: it is a repeat of equal texts that have one;
                         rows without id are not repeats of each other, and have no labels
    repeated rows        each row is a document; rows of one id are not repeats of each other
    repeated labels      a document is good or toxic if any of its labels says so
    long texts           read whole
    empty table          empty result
    clashing columns     only the id, text, part and label columns are read
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrosight.llm.common import cut, small_batches

LARGEST_ID = (1 << 63) - 1
#: parts and labels whose counts a task holds before it writes them out
MAX_PARTS = 50_000

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a character after its first
_SIGNS = re.compile(rb"[#$%&*|]")

#: a filter is true for a text that fails it: (text, words) as bytes
Filter = Callable[[bytes, list[bytes]], bool]
TEXT_FILTERS: dict[str, Filter] = {
    "A": lambda text, words: len(words) < 200,
    "B": lambda text, words: 100 * len(set(words)) < 50 * len(words),
    "C": lambda text, words: 100 * (len(text) - len(text.translate(None, _CAPITALS)))
    > 3 * len(text.translate(None, _FOLLOWING)),
    "D": lambda text, words: _SIGNS.search(text) is not None,
}
REPEATS = "E"
SUBSETS = 32


def survival_words() -> np.ndarray:
    """The word of each set of failed filters: bit s is set when no filter of s failed."""
    return np.array([sum(1 << s for s in range(SUBSETS) if not failed & s) for failed in range(SUBSETS)], np.uint32)


def _bits(words: np.ndarray) -> np.ndarray:
    """How many of a few words have each bit."""
    return ((words[:, None] >> np.arange(SUBSETS, dtype=np.uint32)) & np.uint32(1)).sum(axis=0).astype(np.int64)


def positional_popcount(words: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each bit, the sum of ``times`` over the words that have it."""
    top = int(times.max()).bit_length() if len(times) else 0
    weights = [[words[(times >> k) & 1 == 1]] for k in range(top)]
    counts, k = np.zeros(SUBSETS, np.int64), 0
    while k < len(weights):
        x = np.concatenate(weights[k])
        while len(x) > 2:
            n = len(x) // 3
            a, b, c = x[:n], x[n:2 * n], x[2 * n:3 * n]
            either = a ^ b
            if k + 1 == len(weights):
                weights.append([])
            weights[k + 1].append((a & b) | (either & c))
            x = np.concatenate([either ^ c, x[3 * n:]])
        counts += _bits(x) << k
        weights[k] = []
        k += 1
    return counts


def _scan(filters: list[Filter]):
    def run(batches):
        for batch in batches:
            failed, digests = [], []
            for text in batch.column(2).to_pylist():
                words = text.split()  # bytes split at exactly \x20 and \x09-\x0D
                failed.append(sum(1 << i for i, fails in enumerate(filters) if fails(text, words)))
                digests.append(hashlib.blake2b(text, digest_size=16).digest())
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(failed, pa.int32()),
                 pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], names=["id", "part", "failed", "d0", "d1"])
    return run


def _count(batches):
    """The survivors of each subset by (part, good, toxic) in this task."""
    table = survival_words()
    held: dict[tuple, np.ndarray] = {}

    def flush():
        keys = list(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
             pa.array([k[2] for k in keys], pa.bool_()),
             pa.array([held[k].tolist() for k in keys], pa.list_(pa.int64()))],
            names=["part", "good", "toxic", "survive"])
    for batch in batches:
        part = batch.column(0).dictionary_encode()
        names = part.dictionary.to_pylist()
        key = (part.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4
               + batch.column(1).to_numpy(zero_copy_only=False) * 2 + batch.column(2).to_numpy(zero_copy_only=False))
        words = table[batch.column(3).to_numpy()]
        times = batch.column(4).to_numpy()
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.diff(key[order], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(order)]):
            at = order[a:b]
            k = int(key[at[0]])
            name = (names[k // 4], bool(k & 2), bool(k & 1))
            counts = positional_popcount(words[at], times[at])
            held[name] = held[name] + counts if name in held else counts
        if len(held) >= MAX_PARTS:
            yield flush()
            held.clear()
    if held:
        yield flush()


def order_rows(letters: str, every: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """One row per order of the filters and step, from the survivors of each subset."""
    bit = {c: 1 << i for i, c in enumerate(letters)}
    whole = (1 << len(letters)) - 1
    n = len(letters)

    def removed(counts, before, c):
        return counts[before] - counts[before | bit[c]]
    shapley = {c: sum(math.factorial(before.bit_count()) * math.factorial(n - 1 - before.bit_count())
                      * removed(every, before, c) for before in range(whole + 1) if not before & bit[c])
               for c in letters}
    rows = []
    for order in itertools.permutations(letters):
        before = 0
        for step, c in enumerate(order, 1):
            here = removed(every, before, c)
            rows.append(("".join(order), step, every[before | bit[c]], here, removed(every, 0, c) - here,
                         removed(every, whole & ~bit[c], c), removed(good, before, c), removed(toxic, before, c),
                         shapley[c]))
            before |= bit[c]
    return rows


_FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _orders(letters: str):
    def run(batches):
        for batch in batches:
            for part, survivors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = sorted((s["subset"], s["n"], s["n_good"], s["n_toxic"]) for s in survivors)
                rows = order_rows(letters, *([c[i] for c in counts] for i in (1, 2, 3)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows), pa.string()), pa.array(cols[0], pa.string()),
                     pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    names=["part", "filter_order", "step", *_FIGURES])
    return run


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter] | None = None,
                 id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. ``filters`` are four letters and their text filters; the
    filter of repeated texts is the fifth, ``E``."""
    filters = filters or TEXT_FILTERS
    letters = "".join(filters) + REPEATS
    if len(letters) != 5 or len(set(letters)) != 5:
        raise ValueError("four text filters with letters other than E make a word of 32 subsets")
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LARGEST_ID)).alias("id"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    with small_batches(docs.sparkSession):
        rows = cut(rows.mapInArrow(_scan(list(filters.values())),
                                   "id bigint, part string, failed int, d0 bigint, d1 bigint"), "audit-rows")
    said = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(
        F.col("doc_id").cast("bigint").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # rows without an id have no labels and would meet in one task
    named = rows.where(F.col("id") < LARGEST_ID).join(said, "id", "left").select(
        *rows.columns, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    nameless = rows.where(F.col("id") == LARGEST_ID).select(*rows.columns, F.lit(False).alias("good"),
                                                            F.lit(False).alias("toxic"))
    kind = ["d0", "d1", "failed", "part", "good", "toxic"]
    by_id = named.unionByName(nameless).groupBy(*kind, "id").agg(F.count(F.lit(1)).alias("n"))
    cells = by_id.groupBy(*kind).agg(F.min("id").alias("first"), F.sum("n").alias("n"),
                                     F.min_by("n", "id").alias("n_first"))
    # a text has a row a part and label here, however many documents share it
    smallest = F.min("first").over(Window.partitionBy("d0", "d1"))
    unique = F.when(F.col("first") == smallest, F.col("n_first")).otherwise(F.lit(0))
    cells = cells.withColumn("unique", unique).select(
        "part", "good", "toxic", F.inline(F.array(
            F.struct(F.col("failed"), F.col("unique").alias("n")),
            F.struct((F.col("failed") + F.lit(1 << (len(letters) - 1))).alias("failed"),
                     (F.col("n") - F.col("unique")).alias("n"))))).where("n > 0")
    counted = cut(cells.mapInArrow(_count, "part string, good boolean, toxic boolean, survive array<bigint>"),
                  "audit-counts")
    n = F.col("survivors")
    by_subset = counted.select("part", "good", "toxic", F.posexplode("survive").alias("subset", "survivors")).groupBy(
        "part", "subset").agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("n_good"),
                              F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("n_toxic"))
    survivors = by_subset.groupBy("part").agg(  # 32 rows a part
        F.collect_list(F.struct("subset", "n", "n_good", "n_toxic")).alias("survivors"))
    return survivors.mapInArrow(_orders(letters), "part string, filter_order string, step int, "
                                + ", ".join(f"{c} bigint" for c in _FIGURES))
