"""Packing documents into training sequences by cutting-stock column generation.

1. Each task encodes its documents, ends each with the id 0 and cuts it into
   pieces of ``size`` tokens; a remainder above half of ``size`` is cut once more
   there, since stock that is cut from halves leaves next to no waste. A piece's
   rank among the pieces of its length class in its task goes with it.
2. Lengths are classed by ``unit`` tokens, rounded up. The histogram of classes
   (at most size / unit numbers) is all that the driver sees. The linear
   program over patterns (multisets of classes in a sequence) asks for the
   fewest sequences: a restricted master by the revised simplex method, whose
   columns a knapsack dynamic program prices. The result is rounded down; what is
   left over (at most a pattern's pieces for each) goes best fit decreasing.
3. Each task's first rank of each class follows from a running sum of (task,
   class) counts; rank in the whole corpus -> pattern, copy of it and slot. The
   offset is the running sum of lengths by slot in a sequence.

A sequence is padded to ``size`` unless its tokens are a power of two.

The ids are those of the tokenizer file by the ``tokenizers`` library; strings of special
tokens in a text become their ids with ``special`` and are ordinary text without. The same vocabulary and merges run in
``tiktoken``, 4 times as fast here; tests hold the two against each other. A text
with a run of white space longer than ``BLANKS`` goes through ``tokenizers`` itself,
since the other's pattern fails on runs of about a million characters.

Defined cases
    null or empty text   the end id alone: one piece of one token
    null doc_id          packed like any other
    repeated rows        each row is packed
    very long text       as many full pieces as it takes
    empty table          no piece
    clashing columns     only the id and text columns are read
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrosight.llm.common import bound_batches, cut

END = 0
#: word pattern of the byte-level tokenizer, a fixed value that belongs to its vocabulary
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: the longest run of white space that goes through the pattern at once; its
#: backtracking gives up at about a million characters
BLANKS = 100_000
_RUN = re.compile(r"\s+")


@lru_cache(maxsize=2)
def encoder(path: str, special: bool = False):
    """The byte-level BPE of a ``tokenizers`` file: text -> array of ids. With ``special``
    the strings of the file's added tokens become their ids, else ordinary text."""
    import tiktoken
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    vocab, added = whole["model"]["vocab"], whole.get("added_tokens") or []
    names = {t["content"]: t["id"] for t in added} if special else {}
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip") if special) or any(
            a != b and a in b for a in names for b in names):  # rules that tiktoken does not have
        return lambda text: np.array(_library(path, special)(text), np.uint32)
    # byte-level vocabularies write each byte as a printable character
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain}
    chars |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(chars[c] for c in token): i for token, i in vocab.items()
             if all(c in chars for c in token) and not (token.startswith("<|") and token.endswith("|>"))}
    bpe = tiktoken.Encoding("byte_bpe", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=names)
    allowed = "all" if special else set()

    def encode(text: str) -> np.ndarray:
        if len(text) > BLANKS and any(m.end() - m.start() > BLANKS for m in _RUN.finditer(text)):
            return np.array(_library(path, special)(text), np.uint32)
        return bpe.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
    return encode


@lru_cache(maxsize=2)
def _library(path: str, special: bool):
    """The file in ``tokenizers`` itself: text -> list of ids."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not special
    return lambda text: t.encode(text, add_special_tokens=False).ids


def cuts(tokens: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    out = [(a, size) for a in range(0, tokens - size + 1, size)]
    start, rest = len(out) * size, tokens % size
    half = size // 2
    if rest > half:
        out.append((start, half))
        start, rest = start + half, rest - half
    return out + ([(start, rest)] if rest else [])


PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "units bigint, rank bigint, task bigint, ids binary")


def _pieces(path: str, size: int, unit: int, with_ids: bool, special: bool):
    def run(batches):
        from pyspark import TaskContext
        encode, task = encoder(path, special), TaskContext.get().partitionId()
        seen = np.zeros(size // unit + 2, np.int64)
        for batch in batches:
            rows, raws = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4").tobytes()
                tokens = len(ids) // 4
                for start, n in cuts(tokens, size):
                    raw, units = ids[4 * start:4 * (start + n)], -(-n // unit)
                    rows.append((doc, start, n, zlib.crc32(raw), tokens, units, int(seen[units]), task))
                    raws.append(raw if with_ids else None)
                    seen[units] += 1
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[i] for r in rows], pa.int64()) for i in range(8)),
                 pa.array(raws, pa.binary())], names=names)
    return run


def _price(units: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: the most valuable pattern and its value."""
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for t in range(1, capacity + 1):
        m = np.searchsorted(units, t, side="right")
        best[t] = best[t - 1]
        if m:
            got = best[t - units[:m]] + value[:m]
            k = int(np.argmax(got))
            if got[k] > best[t] + 1e-12:
                best[t], item[t] = got[k], k
    pattern, t = np.zeros(len(units)), capacity
    while t > 0:
        if item[t] < 0:
            t -= 1
        else:
            pattern[item[t]] += 1
            t -= int(units[item[t]])
    return float(best[capacity]), pattern


def column_generation(units: np.ndarray, counts: np.ndarray, capacity: int, tolerance: float = 1e-3,
                      rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Patterns (counts by unit length) and how often to use each: fewest
    sequences by the linear program, within ``tolerance`` of its optimum. The
    basis inverse is only updated; ``plan`` never uses more than there is, so
    rounding errors cost some padding at most."""
    m = len(units)
    copies = capacity // units
    basis, inverse = np.diag(copies.astype(float)), np.diag(1.0 / copies)
    x = counts / copies
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        value, column = _price(units, np.maximum(dual, 0.0), capacity)
        # Farley's bound: the optimum is at least this
        if value <= 1 + 1e-9 or x.sum() <= (dual @ counts) / value * (1 + tolerance):
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1.0), np.inf)
        r = int(np.argmin(ratio))
        theta = ratio[r]
        x = np.maximum(x - theta * step, 0.0)
        x[r] = theta
        row = inverse[r] / step[r]
        inverse -= np.outer(step, row)
        inverse[r] = row
        basis[:, r] = column
    return [(basis[:, j].astype(np.int64), float(x[j])) for j in range(m) if x[j] > 1e-9]


def plan(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length class the rows (first rank, first sequence, copies in a
    sequence, slot of the first copy), by rank."""
    out: dict[int, list] = {n: [] for n in histogram}
    used = dict.fromkeys(histogram, 0)
    sequence = 0

    def place(pattern: list[tuple[int, int]], times: int) -> None:
        nonlocal sequence
        slot = 0
        for n, a in pattern:
            out[n].append((used[n], sequence, a, slot))
            used[n] += a * times
            slot += a
        sequence += times

    if histogram.get(capacity):
        place([(capacity, 1)], histogram[capacity])
    units = np.array(sorted(n for n in histogram if n != capacity and histogram[n] > 0), np.int64)
    if len(units):
        left = np.array([histogram[int(n)] for n in units], np.int64)
        for column, x in sorted(column_generation(units, left.astype(float), capacity), key=lambda p: -p[1]):
            at = np.flatnonzero(column)
            times = min(int(x + 1e-6), int((left[at] // column[at]).min()))
            if times:
                left[at] -= column[at] * times
                place([(int(units[i]), int(column[i])) for i in at[::-1]], times)
        # what rounding leaves, at most a pattern's pieces each: best fit decreasing
        room: list[list] = [[] for _ in range(capacity + 1)]  # sequences by free units
        for i in range(len(units) - 1, -1, -1):
            n = int(units[i])
            for _ in range(int(left[i])):
                free = next((f for f in range(n, capacity + 1) if room[f]), None)
                b = room[free].pop() if free is not None else {}
                b[n] = b.get(n, 0) + 1
                room[(capacity if free is None else free) - n].append(b)
        for b in (b for found in room for b in found):
            place(list(b.items()), 1)
    return {n: np.array(rows, np.int64).reshape(-1, 4) for n, rows in out.items()}


def _assign(plans: dict[int, np.ndarray], names: list[str]):
    """Replaces units and rank by sequence and slot."""
    def run(batches):
        for batch in batches:
            units, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(units):
                rows, at = plans[int(n)], np.flatnonzero(units == n)
                p = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                k = rank[at] - p[:, 0]
                sequence[at] = p[:, 1] + k // p[:, 2]
                slot[at] = p[:, 3] + k % p[:, 2]
            yield pa.RecordBatch.from_arrays([pa.array(sequence), pa.array(slot), *batch.columns[2:]],
                                             names=names)
    return run


def pack(df: DataFrame, tokenizer: str, size: int = 1024, unit: int = 4, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False, special: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``with_ids`` the ids (little-endian 32 bit). ``special``
    is that of ``encoder``."""
    bound_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    pieces = cut(docs.mapInArrow(_pieces(tokenizer, size, unit, with_ids, special), PIECES), "pieces")
    tasks = pieces.groupBy("task", "units").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["units"]: r["n"] for r in
                 pieces.groupBy("units").agg(F.count(F.lit(1)).alias("n")).collect()}
    plans = plan(histogram, size // unit)
    before = Window.partitionBy("units").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = tasks.select("task", "units", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    ranked = pieces.join(first, ["task", "units"]).select(
        "units", (F.col("first") + F.col("rank")).alias("rank"), *kept)
    placed = ranked.mapInArrow(
        _assign(plans, ["sequence_id", "slot", *kept]),
        "sequence_id bigint, slot bigint, " + ", ".join(
            f"{c} {'binary' if c == 'ids' else 'bigint'}" for c in kept))
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*kept[:5], "sequence_id",
                         F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"), *kept[5:])
