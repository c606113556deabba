"""Toxicity: Levenshtein automata over a lexicon trie, and context windows.

Lexicon (learned, never from held-out rows): from at most ``PER_CLASS``
labelled documents of each class, the words of four letters or more, and the
stems (first four to six letters of longer words), whose frequency among toxic
documents is ``MIN_RATIO`` times that among clean ones and whose
log-likelihood ratio is ``MIN_G2`` or more; stems occur in no clean document
and in ``MIN_VARIANTS`` words.  A toxic document counts once per word, and only
as often as the ``SIDE`` words before it and those after it differ (beyond the
text's ends: its whole text), so the words of a copied text or passage do not
become terms, while one that mostly follows the same few words does.  The counts are made in Spark; ``MAX_TERMS`` bounds the lexicon.

Matching: the terms form a trie; a word's Levenshtein automaton (bit-parallel,
one error, for terms of five letters or more) is intersected with it, so every
misspelling by one insertion, deletion or substitution is found in one
walk.  Words that share neither half with any term cannot be within one
error and skip the walk.  Results are remembered per word in a bounded memo.

Context: each hit is weighed by its window of ``CONTEXT`` words to both sides:
a hit between quotation marks or after a word of reporting (``said``, ...)
counts a share of a plain one, further hits in the window raise it.  A
logistic regression over the weighed hits by kind, their density and the
quoted ones gives the score; its weights are drawn towards ``PRIOR``, so kinds
of hits that the labelled documents do not show keep a defined meaning.

Without labels of both classes the score is the share of label 1 (0.5 without
labels).  Null and empty texts have no hits and get the score of hit-free
texts.  Repeated rows get equal scores; an empty table gives no rows.
Scoring is a narrow map; the model is broadcast and bounded.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.llm.common import scratch_table, sliced, small_batches, text_bytes
from seedlabel.llm.labelled import held_out, label_rows, sample

HOLD_MODULUS, HOLD_REMAINDER = 5, 0
THRESHOLD = 0.5
PER_CLASS = 1000
MIN_RATIO, MIN_G2, MIN_LETTERS, FUZZY_LETTERS = 30.0, 20.0, 4, 5
STEM_LETTERS, MIN_VARIANTS = (4, 5, 6), 3
CONTEXT = 8
#: Words on each side that tell the uses of a word from copies: passages of twice as many are copies.
SIDE = 4
#: Tokens remembered per worker, and the characters of the longest one.
MEMO = 300_000
MEMO_CHARS = 64

EXACT, STEM, FUZZY = 1, 2, 3
#: What is left of a hit inside a quotation or report.
QUOTED = 0.3
#: Features: weighed hits by kind (exact, stem, misspelled; log), density, log of quoted hits.
PRIOR = np.array([4.0, 3.0, 2.0, 1.0, -0.5])
PULL = 1e-3
OPENING, CLOSING = "\"“„«‘", "\"”“»’"
REPORTING = frozenset("said says wrote writes called calls quote quoted quoting reported saying word term".split())

_PARTS = re.compile(r"[^\W_]+")


def folded_words(text: str) -> list[str]:
    """Letters-and-digits words, lower-cased."""
    return _PARTS.findall(text.lower())


class Trie:
    """Lexicon trie: nodes are dicts by letter; "" marks the end of a term."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.root: dict = {}
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        for term, kind in [(t, EXACT) for t in terms] + [(s, STEM) for s in stems]:
            node = self.root
            for ch in term:
                node = node.setdefault(ch, {})
            node[""] = min(kind, node.get("", kind))
        for t in (t for t in terms if len(t) >= FUZZY_LETTERS):  # one error leaves a half as it is
            h = len(t) // 2
            self.heads.setdefault(h, set()).add(t[:h])
            self.tails.setdefault(len(t) - h, set()).add(t[h:])

    def lookup(self, word: str) -> int:
        """EXACT, STEM, FUZZY or 0."""
        node = self.root
        stem = 0
        for ch in word:
            node = node.get(ch)
            if node is None:
                break
            if node.get("") == STEM:
                stem = STEM
        else:
            if node.get("") == EXACT:
                return EXACT
        if stem:
            return STEM
        if len(word) >= FUZZY_LETTERS - 1 and (any(word[:n] in s for n, s in self.heads.items())
                                             or any(word[-n:] in s for n, s in self.tails.items())):
            return FUZZY if self.within_one(word) else 0
        return 0

    def within_one(self, word: str) -> bool:
        """Intersect the word's automaton (bit i: i letters read) with the trie."""
        n = len(word)
        masks: dict[str, int] = {}
        for i, ch in enumerate(word):
            masks[ch] = masks.get(ch, 0) | 1 << i
        accept = 1 << n
        # states without an error, and with one (a letter of the word may be skipped)
        stack = [(self.root, 0, 1, 2)]
        while stack:
            node, depth, clean, once = stack.pop()
            if depth >= FUZZY_LETTERS and node.get("") == EXACT and (clean | once) & accept:
                return True
            for ch, child in node.items():
                if not ch:
                    continue
                m = masks.get(ch, 0)
                c = (clean & m) << 1
                o = (once & m) << 1 | clean | clean << 1 | c << 1
                o &= (accept << 1) - 1
                if c or o:
                    stack.append((child, depth + 1, c, o))
        return False


class Memo(dict):
    """white-space token -> kind of its strongest word."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, token: str) -> int:
        kinds = [k for k in map(self.trie.lookup, _PARTS.findall(token)) if k]
        kind = min(kinds) if kinds else 0
        if len(token) > MEMO_CHARS:  # long runs without blanks: not worth their bytes
            return kind
        if len(self) >= MEMO:
            self.clear()
        self[token] = kind
        return kind


def quoted(tokens: list[str], at: int) -> bool:
    """Whether token ``at`` lies between quotation marks or after a reporting
    word, within its context window."""
    lo, hi = max(0, at - CONTEXT), min(len(tokens), at + CONTEXT + 1)
    if any(t.strip(".,;:!?") in REPORTING for t in tokens[lo:at]):
        return True
    opened = any(tokens[i][0] in OPENING for i in range(lo, at + 1))
    closed = any(tokens[i].rstrip(".,;:!?")[-1:] in CLOSING and tokens[i].rstrip(".,;:!?")[-1:]
                 for i in range(at, hi))
    return opened and closed


def hit_features(text: str, memo: Memo) -> np.ndarray:
    """Each distinct hit word counts once, by its strongest occurrence."""
    tokens = text.lower().split()
    out = np.zeros(len(PRIOR))
    hits = [(i, k) for i, k in enumerate([memo[t] for t in tokens]) if k]
    best: dict[tuple[int, str], float] = {}
    in_quotes: set[str] = set()
    last = -CONTEXT - 1
    for n, (i, kind) in enumerate(hits):
        after = hits[n + 1][0] if n + 1 < len(hits) else i + CONTEXT + 1
        word = "".join(_PARTS.findall(tokens[i]))
        strength = 1 + 0.1 * ((i - last <= CONTEXT) + (after - i <= CONTEXT))
        if best.get((kind, word), 0) < strength:
            if quoted(tokens, i):
                strength *= QUOTED
                in_quotes.add(word)
            best[kind, word] = max(strength, best.get((kind, word), 0))
        last = i
    for (kind, _), strength in best.items():
        out[kind - 1] += strength
    if hits:
        out[3] = min(1.0, 20 * out[:3].sum() / len(tokens))
    out[4] = len(in_quotes)
    out[[0, 1, 2, 4]] = np.log1p(out[[0, 1, 2, 4]])
    return out


class Model:
    def __init__(self, terms: list[str], stems: list[str], intercept: float, weights: np.ndarray):
        self.terms, self.stems, self.intercept, self.weights = terms, stems, intercept, weights

    @functools.cached_property
    def memo(self) -> Memo:
        return Memo(Trie(self.terms, self.stems))

    def score(self, text: str) -> float:
        z = self.intercept + float(hit_features(text, self.memo) @ self.weights)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memo"}


def _side(words: list[str], whole: list[str]) -> int:
    return zlib.crc32(" ".join(words if len(words) == SIDE else words + whole).encode())


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, text) -> each text's distinct words and stems (with the word they were
    first seen in), and digests of what is before and after."""
    for batch in sliced(batches, 1):
        ys, terms, stem, words, before, after = [], [], [], [], [], []
        for y, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            seen: dict[tuple[str, bool], tuple[str, int]] = {}
            text = folded_words(raw.as_py().decode(errors="replace"))
            for i, w in enumerate(text):
                if len(w) >= MIN_LETTERS and w.isalpha() and (w, False) not in seen:
                    seen[w, False] = (w, i)
                    for n in STEM_LETTERS:
                        if len(w) > n:
                            seen.setdefault((w[:n], True), (w, i))
            whole = [str(zlib.crc32(" ".join(text).encode()))]
            sides = {i: (_side(text[max(0, i - SIDE):i], whole), _side(text[i + 1:i + 1 + SIDE], whole))
                     for i in {i for _, i in seen.values()}}
            ys += [y] * len(seen)
            terms += [t for t, _ in seen]
            stem += [x for _, x in seen]
            words += [w for w, _ in seen.values()]
            before += [sides[i][0] for _, i in seen.values()]
            after += [sides[i][1] for _, i in seen.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ys, pa.int32()), pa.array(terms, pa.string()), pa.array(stem, pa.bool_()),
             pa.array(words, pa.string()), pa.array(before, pa.int64()), pa.array(after, pa.int64())],
            ["y", "term", "stem", "word", "before", "after"])


def lexicon(picked: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[str], list[str]]:
    """Terms and stems from (y, text) rows, counted in Spark.  Every term that
    passes is kept: it needs about 15 of the at most ``PER_CLASS`` toxic texts,
    so there are no more than a fifteenth of the sample's words."""
    rows = picked.select("y", "text").mapInArrow(
        _terms, "y int, term string, stem boolean, word string, before long, after long")
    ours = F.col("y") == 1
    counts = rows.groupBy("term", "stem").agg(
        F.sum("y").alias("docs"), F.countDistinct(F.when(ours, F.col("before"))).alias("befores"),
        F.countDistinct(F.when(ours, F.col("after"))).alias("afters"),
        F.countDistinct(F.when(ours, F.col("word"))).alias("variants"), F.sum(1 - F.col("y")).cast("double").alias("c"))
    counts = counts.withColumn("t", F.least("docs", "befores", "afters").cast("double"))
    share = n_toxic / max(n_toxic + n_clean, 1)
    both = F.col("t") + F.col("c")
    part = lambda n, p: F.when(n > 0, n * F.log(n / (both * p))).otherwise(0.0)
    good = (counts.withColumn("g2", 2 * (part(F.col("t"), share) + part(F.col("c"), 1 - share)))
            .filter((F.col("g2") >= MIN_G2) & (F.col("t") * n_clean >= F.col("c") * n_toxic * MIN_RATIO))
            .filter(~F.col("stem") | ((F.col("c") == 0) & (F.col("variants") >= MIN_VARIANTS)))
            .select("term", "stem").collect())
    short: list[str] = []
    for s in sorted((r.term for r in good if r.stem), key=lambda s: (len(s), s)):
        if not s.startswith(tuple(short)):  # a stem that begins with another adds nothing
            short.append(s)
    return sorted(r.term for r in good if not r.stem), short


def _hits(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    memo = shared.value.memo
    for batch in sliced(batches, 1):
        rows = [hit_features(raw.as_py().decode(errors="replace"), memo).tolist() for raw in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic regression, both classes alike, drawn towards PRIOR; evidence
    weights stay non-negative."""
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    b, w = -2.0, PRIOR.copy()
    for _ in range(3000):
        g = weight * (1 / (1 + np.exp(-np.clip(b + x @ w, -40, 40))) - y)
        b -= g.sum()
        w -= g @ x + PULL * (w - PRIOR)
        w[:4] = np.maximum(w[:4], 0)
    return b, w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    rows = label_rows(labels, label, HOLD_MODULUS, HOLD_REMAINDER)
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < n:
        share = min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6)
        return Model([], [], float(np.log(share / (1 - share))), np.zeros(len(PRIOR)))
    narrow = small_batches(docs).select("doc_id", text_bytes(F.col("text")).alias("text"))
    picked = scratch_table(sample(narrow, rows, per_class, ["text"]).select("y", "text"), "toxicity-sample")
    found = {r.y: r["count"] for r in picked.groupBy("y").count().collect()}
    terms, stems = lexicon(picked, found.get(1, 0), found.get(0, 0))
    shared = docs.sparkSession.sparkContext.broadcast(Model(terms, stems, 0.0, np.zeros(len(PRIOR))))
    rows = picked.mapInArrow(lambda it: _hits(it, shared), "y int, x array<double>").collect()
    rows = sorted((r.y, *r.x) for r in rows)  # whatever order the tasks ended in
    if len({r[0] for r in rows}) < 2:
        return Model(terms, stems, float(np.log(ones / (n - ones))), np.zeros(len(PRIOR)))
    data = np.array(rows, dtype=np.float64)
    return Model(terms, stems, *fit(data[:, 1:], data[:, 0]))


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in sliced(batches, 1):
        scores = [model.score(raw.as_py().decode(errors="replace")) for raw in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label))
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("text"))
    out = rows.mapInArrow(lambda it: _scored(it, shared), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), HOLD_MODULUS, HOLD_REMAINDER).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
