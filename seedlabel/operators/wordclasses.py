"""Word classes from a hidden Markov model of the sentences.

A tagger's noun / adjective tags are replaced by classes learned from the texts
alone: every sentence is a chain of ``states`` hidden classes that emit its
tokens.  Expectation sums (forward-backward) are made per task in Arrow batches
and added by one aggregate per iteration; Viterbi decoding tags every token, and
a word's class is the one its occurrences get most often.

Symbols.  The ``head`` most frequent words emit as themselves; every other word
emits as one of ``tails`` hashed endings of up to three characters, as taggers
treat unknown words.  The model is thus a table of (head + tails) x states
numbers whatever the corpus, and only the head words are sent to the tasks.

All chains of a batch advance together, the longest first, so a step is one
small matrix product.  Sums from tasks are rounded to PLACES places before they
are added as whole numbers, so a model does not depend on partitions beyond the
last place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = 8
HEAD, TAILS = 32768, 512
ITERATIONS = 5
SEED = 42
SMOOTH = 0.1
PLACES = 6
#: Tokens handled at once in a task (work arrays are tokens x states doubles).
BATCH_TOKENS = 1 << 17


@dataclass
class Model:
    start: np.ndarray       # (states,)
    move: np.ndarray        # (states, states): from, to
    emit: np.ndarray        # (symbols, states): P(symbol | state)
    history: list           # log-likelihood per iteration


class Symbols:
    """Word -> symbol number."""

    def __init__(self, head: list[str], tails: int):
        self.number = {w: i for i, w in enumerate(head)}
        self.n_head, self.tails, self.size = len(head), tails, len(head) + tails

    def of(self, words: list[str]) -> np.ndarray:
        get, n, tails = self.number.get, self.n_head, self.tails
        return np.array([get(w, -1) if w in self.number else n + xxhash.xxh64_intdigest(w[-3:]) % tails for w in words],
                        np.int64)


def head_words(sent: DataFrame, head: int = HEAD, tokens_col: str = "tokens") -> list[str]:
    """The ``head`` most frequent words (a bounded list), most frequent first."""
    counts = sent.select(F.explode(tokens_col).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(head).collect()]


def start_model(n_symbols: int, states: int = STATES, seed: int = SEED) -> Model:
    """Near-uniform tables, broken apart by a seeded generator."""
    rng = np.random.Generator(np.random.Philox(seed))

    def rows(shape):
        t = 1.0 + rng.random(shape)
        return t / t.sum(axis=-1, keepdims=True)

    return Model(rows(states), rows((states, states)), rows((states, n_symbols)).T.copy(), [])


def _chains(column: pa.Array, symbols: Symbols) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols of the tokens, starts, lengths) of runs of sentences with about
    BATCH_TOKENS tokens; sentences without tokens have length 0."""
    sizes = np.diff(column.offsets.to_numpy())
    coded = column.flatten().dictionary_encode()
    number = symbols.of(coded.dictionary.to_pylist())
    tokens = number[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at] - sizes[at]
        to = max(int(np.searchsorted(ends, base + BATCH_TOKENS, "right")), at + 1)
        yield tokens[base:ends[to - 1]], ends[at:to] - sizes[at:to] - base, sizes[at:to]
        at = to


def _ordered(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Starts of non-empty chains, longest first, and how many chains reach each step."""
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    order = order[lengths > 0]
    lengths = lengths[:len(order)]
    reach = [int(np.searchsorted(-lengths, -t, "left")) for t in range(int(lengths[0]) if len(lengths) else 0)]
    return order, reach


def expectations(tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: Model):
    """(start sums, move sums, per-token state probabilities, log-likelihood) of chains."""
    states = len(model.start)
    order, reach = _ordered(starts, lengths)
    first = starts[order]
    e = model.emit[tokens]
    alpha, scale = np.zeros((len(tokens), states)), np.ones(len(tokens))
    for t, n in enumerate(reach):
        at = first[:n] + t
        a = (model.start if t == 0 else alpha[at - 1] @ model.move) * e[at]
        scale[at] = np.maximum(a.sum(axis=1), 1e-300)
        alpha[at] = a / scale[at][:, None]
    beta = np.ones((len(tokens), states))
    move = np.zeros((states, states))
    for t in range(len(reach) - 1, 0, -1):
        at = first[:reach[t]] + t
        ahead = e[at] * beta[at] / scale[at][:, None]
        beta[at - 1] = ahead @ model.move.T
        move += model.move * (alpha[at - 1].T @ ahead)
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(axis=1, keepdims=True), 1e-300)
    return gamma[first].sum(axis=0), move, gamma, float(np.log(scale).sum())


def viterbi(tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """The likeliest state of every token (lowest state on ties)."""
    order, reach = _ordered(starts, lengths)
    first = starts[order]
    with np.errstate(divide="ignore"):
        le, lm, ls = np.log(model.emit)[tokens], np.log(model.move), np.log(model.start)
    best, back = np.zeros((len(tokens), len(ls))), np.zeros((len(tokens), len(ls)), np.int8)
    for t, n in enumerate(reach):
        at = first[:n] + t
        if t == 0:
            best[at] = ls + le[at]
        else:
            paths = best[at - 1][:, :, None] + lm[None]
            back[at] = paths.argmax(axis=1)
            best[at] = paths.max(axis=1) + le[at]
    tags = np.zeros(len(tokens), np.int64)
    for t in range(len(reach) - 1, -1, -1):
        n, longer = reach[t], reach[t + 1] if t + 1 < len(reach) else 0
        at = first[:n] + t
        tags[at] = best[at].argmax(axis=1)
        tags[at[:longer]] = back[at[:longer] + 1, tags[at[:longer] + 1]]
    return tags


def fit(sent: DataFrame, states: int = STATES, head: int = HEAD, tails: int = TAILS, iterations: int = ITERATIONS,
        tokens_col: str = "tokens") -> tuple[Model, Symbols]:
    """Expectation-maximisation over all sentences; one aggregate per iteration."""
    spark = sent.sparkSession
    symbols = Symbols(head_words(sent, head, tokens_col), tails)
    model = start_model(symbols.size, states)
    shared = spark.sparkContext.broadcast(symbols)
    rows = sent.select(tokens_col)
    unit = 10.0 ** PLACES
    for _ in range(iterations):
        now = spark.sparkContext.broadcast((model.start, model.move, model.emit))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Model(*now.value, [])
            s0, mv, em, ll = np.zeros(states), np.zeros((states, states)), np.zeros((shared.value.size, states)), 0.0
            for batch in batches:
                for tokens, starts, lengths in _chains(batch.column(0), shared.value):
                    a, b, gamma, one = expectations(tokens, starts, lengths, m)
                    s0, mv, ll = s0 + a, mv + b, ll + one
                    for k in range(states):
                        em[:, k] += np.bincount(tokens, gamma[:, k], len(em))
            flat = np.concatenate([[ll], s0, mv.ravel(), em.ravel()])
            kept = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(np.round(flat[kept] * unit).astype(np.int64))],
                                             ["i", "v"])

        total = (rows.mapInArrow(sums, "i long, v long").groupBy("i").agg(F.sum("v").alias("v"))).toArrow()
        flat = np.zeros(1 + states + states * states + symbols.size * states)
        flat[total.column("i").to_numpy()] = total.column("v").to_numpy() / unit
        s0, mv = flat[1:1 + states] + SMOOTH, flat[1 + states:1 + states + states * states].reshape(states, states) + SMOOTH
        em = flat[1 + states + states * states:].reshape(-1, states) + SMOOTH / symbols.size
        model = Model(s0 / s0.sum(), mv / mv.sum(axis=1, keepdims=True), em / em.sum(axis=0), [*model.history, flat[0]])
        now.unpersist()
    return model, symbols


def tag_counts(sent: DataFrame, model: Model, symbols: Symbols, tokens_col: str = "tokens") -> DataFrame:
    """``(word, tag, n)``: how often every word is decoded as each class."""
    shared = sent.sparkSession.sparkContext.broadcast((model, symbols))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, s = shared.value
        for batch in batches:
            tags = [viterbi(t, a, n, m) for t, a, n in _chains(batch.column(0), s)]
            words = batch.column(0).flatten().dictionary_encode()
            if not len(words):
                continue
            keys, n = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 128
                                + np.concatenate(tags), return_counts=True)
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(keys // 128)).cast(pa.string()),
                                              pa.array((keys % 128).astype(np.int32)), pa.array(n)], ["word", "tag", "n"])

    return (sent.select(tokens_col).mapInArrow(decode, "word string, tag int, n long")
            .groupBy("word", "tag").agg(F.sum("n").alias("n")))


def word_tags(counts: DataFrame) -> DataFrame:
    """``(word, tag, n, total)``: a word's most frequent class (lowest on ties)."""
    best = counts.groupBy("word").agg(F.max(F.struct("n", (-F.col("tag")).alias("t"))).alias("b"), F.sum("n").alias("total"))
    return best.select("word", (-F.col("b.t")).cast("int").alias("tag"), F.col("b.n").alias("n"), "total")
