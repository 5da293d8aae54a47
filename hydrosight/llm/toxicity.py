"""Toxicity by a lexicon that is matched with misspellings and read in context.

* The lexicon is learned from the training labels (a bounded sample of at most
  about ``max_labelled`` rows): words, and stems of 4 to 6 letters, that toxic texts hold
  far more often than others (``min_log_odds``) and in enough texts.
* A trie of the lexicon is intersected with Levenshtein automata: a state is
  the set of (trie node, edits so far), made deterministic as words need it. Terms of at least
  ``fuzzy_from`` letters may differ by one edit; stems take any ending. Words are runs of letters;
  one with digits or substitute signs inside (``idi0t``) is matched whole where none of its runs matches.
* Each match is weighed by its place: inside quotation marks, on a line that quotes (``>``)
  or near a word of reporting it counts as quotation, else as abuse. Counts,
  shares and the densest window of abuse are the features of a
  logistic regression, fitted on the same bounded sample.

Bounds: about ``max_labelled`` labels, and as many of their rows where ids repeat; the ``max_terms``
strongest entries, of at most four times as many that pass ``min_log_odds`` and that ``min_texts`` texts
and ``min_share`` of the toxic sample hold; a quotation of over 400 characters counts as use.

Defined cases
    null or empty text   no match: the score of a text without any, which is low
    null label           never learned from
    null doc_id          the fold of the empty text; matches no label
    repeated rows        each is scored; a repeated label row counts each time
    ties                 entries of equal strength go by name
    no toxic label       the lexicon is empty and every score 0
    very long text       read whole, in time proportional to its length and hits
    empty table          empty result
    clashing columns     only the id, text and label columns are read
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrosight.llm.common import bound_batches, cut, held_out

_WORD = re.compile(r"[^\W\d_]+")
#: digits and the usual substitute signs inside a word, and a word that holds some
_INNER = re.compile(r"(?<=[^\W\d_])[\d@*$!#+|_]++(?=[^\W\d_])")
_DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[\d@*$!#+|_]++[^\W\d_]++)+")
_QUOTED = re.compile(r"\"[^\"\n]{1,400}\"|“[^”\n]{1,400}”|«[^»\n]{1,400}»|„[^“\n]{1,400}“|^>.*$", re.M)
#: words near which a term is rather reported than used
REPORTING = frozenset("said says saying called calls quote quoted quotes wrote writes word term phrase".split())
STEMS = (4, 5, 6)
FEATURES = ("exact", "fuzzy", "quoted", "kinds", "share", "window")


# --- the automaton ---------------------------------------------------------------------------

@dataclass
class _Node:
    next: dict = field(default_factory=dict)
    term: bool = False  # a whole word ends here
    stem: bool = False  # a stem ends here
    edits: int = 0  # allowed for what ends here or below


class _State:
    """A set of (trie node, edits) with its transitions, made when first needed."""
    __slots__ = ("items", "next", "word", "stem")

    def __init__(self, items: dict):
        self.items, self.next = items, {}
        self.word = min((e for n, e in items.values() if n.term and e <= n.edits), default=None)
        self.stem = min((e for n, e in items.values() if n.stem and e <= n.edits), default=None)


class Matcher:
    """Words within the allowed edits of a lexicon's terms or stems."""

    def __init__(self, terms: list[str], stems: list[str], fuzzy_from: int = 5, edits: int = 1):
        self.root, self.states, self.cache = _Node(), {}, {}
        for words, kind in ((terms, "term"), (stems, "stem")):
            for w in words:
                node, allowed = self.root, edits if len(w) >= fuzzy_from else 0
                for c in w:
                    node.edits = max(node.edits, allowed)
                    node = node.next.setdefault(c, _Node())
                setattr(node, kind, True)
                node.edits = max(node.edits, allowed)
        self.most = edits
        self.start = self._state([(self.root, 0)])

    def _state(self, items) -> _State | None:
        """Closes the items under deletion (a letter of the term left out)."""
        best: dict = {}
        work = list(items)
        while work:
            node, e = work.pop()
            if e > min(self.most, node.edits) or best.get(id(node), (None, 99))[1] <= e:
                continue
            best[id(node)] = (node, e)
            work.extend((child, e + 1) for child in node.next.values())
        if not best:
            return None
        key = frozenset((k, e) for k, (_, e) in best.items())
        if key not in self.states:
            self.states[key] = _State(best)
        return self.states[key]

    def _step(self, state: _State, c: str) -> _State | None:
        items = []
        for node, e in state.items.values():
            if c in node.next:
                items.append((node.next[c], e))
            items.append((node, e + 1))  # a letter too many
            items.extend((child, e + 1) for child in node.next.values())  # another letter
        state.next[c] = out = self._state(items)
        return out

    def match(self, word: str) -> int | None:
        """Edits of the best match (0: exact), None without one."""
        state, found = self.start, None
        for c in word:
            state = state.next[c] if c in state.next else self._step(state, c)
            if state is None:
                return found
            if state.stem is not None and (found is None or state.stem < found):
                found = state.stem
                if found == 0:
                    return 0
        return state.word if found is None or (state.word is not None and state.word < found) else found

    def hits(self, words) -> dict[str, int]:
        """The matching ones of a text's words, with their edits."""
        out = {}
        for w in set(words):
            e = self.cache.get(w, -1)
            if e == -1:
                if len(self.cache) > 300_000:  # a memory of answers, not of rows
                    self.cache.clear()
                e = self.cache[w] = self.match(w)
            if e is not None:
                out[w] = e
        return out


def _disguised(low: str, hits: dict[str, int], matcher: Matcher) -> dict[int, tuple[str, int]]:
    """Words with digits or signs inside that match as a whole while no run of letters in
    them does: by their start, with their edits."""
    if not _INNER.search(low):
        return {}
    found = [m for m in _DISGUISED.finditer(low) if not any(w in hits for w in _WORD.findall(m.group()))]
    edits = matcher.hits(m.group() for m in found)
    return {m.start(): (m.group(), edits[m.group()]) for m in found if m.group() in edits}


def features(text: str | None, matcher: Matcher, window: int) -> tuple[float, ...]:
    low = (text or "").lower()
    words = _WORD.findall(low)
    hits = matcher.hits(words)
    disguised = _disguised(low, hits, matcher)
    if not hits and not disguised:
        return (0.0,) * len(FEATURES)
    spans = [m.span() for m in _QUOTED.finditer(low)]
    exact = fuzzy = quoted = 0
    kinds, places, k = set(), [], 0
    near = [i for i, w in enumerate(words) if w in REPORTING]
    for i, m in enumerate(_WORD.finditer(low)):
        word, e = m.group(), hits.get(m.group())
        if e is None:
            word, e = disguised.get(m.start(), (word, None))
        if e is None:
            continue
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        j = bisect_left(near, i)
        told = any(abs(near[x] - i) <= 3 for x in (j - 1, j) if 0 <= x < len(near))
        if told or k < len(spans) and spans[k][0] <= m.start():
            quoted += 1
            continue
        exact, fuzzy = exact + (e == 0), fuzzy + (e > 0)
        if e == 0:
            kinds.add(word)
        places.append(i)
    at = np.array(places, np.int64)
    densest = int((np.searchsorted(at, at + window) - np.arange(len(at))).max()) if len(at) else 0
    return (math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(len(kinds)),
            math.log1p(1000 * exact / max(1, len(words))), math.log1p(densest))


# --- learning --------------------------------------------------------------------------------

def _entries(batches):
    """Words (kind 0) and stems (kind 1) of labelled texts: texts with them, and toxic ones."""
    all_, toxic = Counter(), Counter()

    def flush():
        keys = list(all_)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([all_[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())],
            names=["entry", "kind", "n", "t"])
    for batch in batches:
        for text, label in zip(*(c.to_pylist() for c in batch.columns)):
            words = set(_WORD.findall((text or "").lower()))
            keys = {(w, 0) for w in words} | {(w[:n], 1) for w in words for n in STEMS if len(w) >= n}
            all_.update(keys)
            if label:
                toxic.update(keys)
            if len(all_) > 500_000:
                yield flush()
                all_.clear()
                toxic.clear()
    if all_:
        yield flush()


def _lexicon(rows, n: int, toxic: int, max_terms: int) -> tuple[list[str], list[str]]:
    """The strongest entries; a stem makes longer ones that it begins needless."""
    def strength(r):
        return (math.log((r["t"] + 0.5) / (toxic + 1))
                - math.log((r["n"] - r["t"] + 0.5) / (n - toxic + 1)))
    rows = sorted(rows, key=lambda r: (-strength(r) * math.sqrt(r["t"]), r["entry"]))[:max_terms]
    stems: list[str] = []
    for r in sorted((r for r in rows if r["kind"] == 1), key=lambda r: (len(r["entry"]), r["entry"])):
        if not any(r["entry"].startswith(s) for s in stems):
            stems.append(r["entry"])
    return sorted(r["entry"] for r in rows if r["kind"] == 0), stems


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Newton's method; the constant comes first and is not penalised."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * penalty
    ridge[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _features_of(terms, stems, fuzzy_from, window):
    def run(batches):
        matcher = Matcher(terms, stems, fuzzy_from)
        for batch in batches:
            f = [features(t, matcher, window) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), batch.column(1)],
                                             names=["f", "label"])
    return run


def _score(terms, stems, weights, fuzzy_from, window, threshold):
    def run(batches):
        matcher = Matcher(terms, stems, fuzzy_from)
        for batch in batches:
            f = np.array([features(t, matcher, window) for t in batch.column(2).to_pylist()])
            f = f.reshape(-1, len(FEATURES))
            s = (np.zeros(len(f)) if weights is None else
                 1 / (1 + np.exp(-np.clip(weights[0] + f @ weights[1:], -30, 30))))
            hits = np.rint(np.expm1(f[:, :3]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()),
                 pa.array((s >= threshold).astype(np.int32)),
                 *(pa.array(hits[:, i].astype(np.int64)) for i in range(3))],
                names=["doc_id", "held_out", "score", "predicted", "n_exact", "n_fuzzy", "n_quoted"])
    return run


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", threshold: float = 0.3, max_labelled: int = 20_000,
             min_log_odds: float = 3.5, min_share: float = 0.008, min_texts: int = 4,
             max_terms: int = 2000, fuzzy_from: int = 5, window: int = 50) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_exact, n_fuzzy, n_quoted."""
    bound_batches(df.sparkSession)
    fold = held_out(F.col(id_col))
    text = F.col(text_col).cast("string")
    marked = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(id_col).cast("bigint").alias("id"), (F.col(label_col) == 1).alias("label"))
    n = marked.count()
    if n > max_labelled:
        draw = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
        marked = marked.where(draw < max_labelled / n)
    sample = cut(df.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
                 .join(marked.hint("shuffle_hash"), "id").select("text", "label"), "labelled")
    rows = sample.count()
    if rows > max_labelled:  # repeated ids: the labels are bounded above, their rows here
        sample = cut(sample.where(F.rand(29) * rows < max_labelled), "labelled-rows")
    totals = sample.agg(F.count(F.lit(1)).alias("n"),
                        F.coalesce(F.sum(F.col("label").cast("int")), F.lit(0)).alias("t")).first()
    n, toxic = totals["n"], totals["t"]
    terms, stems, weights = [], [], None
    if toxic:
        entries = (sample.mapInArrow(_entries, "entry string, kind int, n bigint, t bigint")
                   .groupBy("entry", "kind").agg(F.sum("n").alias("n"), F.sum("t").alias("t")))
        odds = (F.log((F.col("t") + 0.5) / (toxic + 1))
                - F.log((F.col("n") - F.col("t") + 0.5) / (n - toxic + 1)))
        strong = entries.where((odds >= min_log_odds) & (F.col("t") >= max(min_texts, min_share * toxic)))
        best = strong.orderBy((odds * F.sqrt("t")).desc(), "entry", "kind").limit(4 * max_terms).collect()
        terms, stems = _lexicon(best, n, toxic, max_terms)
        rows = sample.mapInArrow(_features_of(terms, stems, fuzzy_from, window),
                                 "f array<double>, label boolean").collect()
        weights = _logistic(np.array([r["f"] for r in rows]), np.array([float(r["label"]) for r in rows]))
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), fold.alias("held_out"),
                     text.alias("text")).mapInArrow(
        _score(terms, stems, weights, fuzzy_from, window, threshold),
        "doc_id bigint, held_out boolean, score double, predicted int, "
        "n_exact bigint, n_fuzzy bigint, n_quoted bigint")
