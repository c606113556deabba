"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pairwise
part in linear time as half of sum_f (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2.

Features of a text: its words, lower-cased and hashed to ``WORD_SLOTS`` slots
(log counts, unit length); structure statistics in [0, 1], as values and as
one-hot tenths; the declared length (column ``n_chars``, when present) as a
one-hot power of two.  Labels, language, source and identifier are no input.

Training: at most ``PER_CLASS`` labelled documents of each class (a documented
bound; never held-out rows), full-batch Adam with fixed steps and seed on the
driver over their sparse features (at most N_FEATURES of eight bytes a text, so
400 MB at worst), the gradient summed over chunks of ``CHUNK_FEATURES``; the intercept is then
moved to the class shares of all labels that may be learned from.  The model is a few hundred KB
whatever the corpus, and is broadcast.  Scoring is a narrow map.

Without labels of both classes the score is the share of label 1 (0.5 without
labels).  Null and empty texts are scored by their statistics like any text;
repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.llm.common import filter_batches, sliced, small_batches, text_bytes
from seedlabel.llm.labelled import held_out, label_rows, sample

HOLD_MODULUS, HOLD_REMAINDER = 4, 2
THRESHOLD = 0.7
PER_CLASS = 1500
WORD_SLOTS = 1 << 14
FACTORS = 6
STEPS, RATE, DECAY = 60, 0.05, 1e-3
#: Features whose gradient is worked out at once (about 100 bytes each meanwhile).
CHUNK_FEATURES = 1 << 20
SEED = 6

_TENTHS = 11
_LENGTHS = 32
_STATS = 16
N_FEATURES = WORD_SLOTS + _STATS * (1 + _TENTHS) + _LENGTHS + 1

_BYTES = np.arange(256)
_CLASSES = np.stack([
    (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 48) & (_BYTES <= 57),
    (_BYTES >= 128), (_BYTES == 10), (_BYTES == 32), np.isin(_BYTES, list(b"!?")), np.isin(_BYTES, list(b".,;:")),
    np.isin(_BYTES, list(b"#$%&*+=<>@^_`{}~\\/")), _BYTES == ord("|"), np.isin(_BYTES, list(b"()[]\"'-")),
]).astype(np.float64)


def statistics(raw: bytes, words: list[bytes], slots: np.ndarray) -> np.ndarray:
    """Structure statistics in [0, 1]; zeros for an empty text."""
    out = np.zeros(_STATS)
    if not words:
        return out
    shares = _CLASSES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    out[:11] = shares
    n = len(words)
    lines = raw.split(b"\n")
    out[11] = len(set(words)) / n
    out[12] = float((slots[1:] == slots[:-1]).sum()) / n
    out[13] = min(1.0, sum(map(len, words)) / n / 20)
    out[14] = len(set(lines)) / len(lines)
    out[15] = min(1.0, np.log2(n + 1) / 16)
    return out


def features(raw: bytes, declared: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text's non-zero features."""
    words = raw.lower().split()
    crc = zlib.crc32
    slots = np.array([crc(w) for w in words], dtype=np.int64) % WORD_SLOTS
    counts = np.bincount(slots, minlength=WORD_SLOTS)
    used = np.nonzero(counts)[0]
    values = np.log1p(counts[used])
    norm = np.sqrt((values * values).sum()) or 1.0
    stats = statistics(raw, words, slots)
    base = WORD_SLOTS
    tenths = base + _STATS + np.arange(_STATS) * _TENTHS + np.minimum(stats * (_TENTHS - 1), _TENTHS - 1).astype(np.int64)
    length = _LENGTHS if declared is None or declared < 0 else min(int(declared).bit_length(), _LENGTHS - 1)
    index = np.concatenate((used, base + np.arange(_STATS), tenths, [base + _STATS * (1 + _TENTHS) + length]))
    value = np.concatenate((values / norm, stats, np.full(_STATS, 0.5), [0.5]))
    return index, value


class FactorisationMachine:
    def __init__(self, intercept: float, linear: np.ndarray, factors: np.ndarray):
        self.intercept, self.linear, self.factors = intercept, linear, factors

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.factors[index] * value[:, None]
        total = vx.sum(axis=0)
        return float(self.intercept + self.linear[index] @ value + 0.5 * (total @ total - (vx * vx).sum()))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.margin(index, value), -40, 40))))


def constant(share: float) -> FactorisationMachine:
    """Scores every text with ``share``."""
    margin = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    return FactorisationMachine(margin, np.zeros(N_FEATURES, np.float32),
                                np.zeros((N_FEATURES, FACTORS), np.float32))


class Chunk:
    """Some rows of the training sample, laid end to end: eight bytes a feature
    are kept; what a gradient needs beside them follows the chunk's size."""

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray]], weight: np.ndarray, place: np.ndarray):
        self.weight = weight
        self.y = np.array([r[0] for r in rows], dtype=np.float32)
        self.lengths = np.array([len(r[1]) for r in rows])
        self.col = np.concatenate([place[r[1]] for r in rows])
        self.val = np.concatenate([r[2] for r in rows]).astype(np.float32, copy=False)

    def add_gradient(self, params: list[np.ndarray], grads: list[np.ndarray]) -> None:
        heads = np.cumsum(self.lengths) - self.lengths
        row = np.repeat(np.arange(len(self.y), dtype=np.int32), self.lengths)
        vx = params[2][self.col]
        vx *= self.val[:, None]
        total = np.add.reduceat(vx, heads, axis=0)
        pair = 0.5 * ((total * total).sum(axis=1) - np.add.reduceat(np.einsum("ij,ij->i", vx, vx), heads))
        margin = params[0][0] + np.add.reduceat(params[1][self.col] * self.val, heads) + pair
        g = self.weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - self.y)
        grow = g[row] * self.val
        np.subtract(total[row], vx, out=vx)
        vx *= grow[:, None]
        n = len(params[1])
        grads[0] += g.sum()
        grads[1] += np.bincount(self.col, weights=grow, minlength=n)
        for f in range(FACTORS):
            grads[2][:, f] += np.bincount(self.col, weights=vx[:, f], minlength=n)


def chunks(rows: list[tuple[int, np.ndarray, np.ndarray]], most: int) -> list[slice]:
    """Runs of rows with at most ``most`` features each (a longer row alone)."""
    out, start, held = [], 0, 0
    for i, r in enumerate(rows):
        if i > start and held + len(r[1]) > most:
            out.append(slice(start, i))
            start, held = i, 0
        held += len(r[1])
    return out + [slice(start, len(rows))]


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], share: float, chunk_features: int = CHUNK_FEATURES
        ) -> FactorisationMachine:
    """Full-batch Adam on the logistic loss of (y, indices, values), its gradient
    summed over chunks of bounded size; both classes weigh alike, then the
    intercept moves to ``share`` of label 1."""
    rng = np.random.default_rng(SEED)
    y = np.array([r[0] for r in rows], dtype=np.float32)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    met = np.zeros(N_FEATURES, bool)
    for r in rows:
        met[r[1]] = True
    seen, place = np.nonzero(met)[0], (np.cumsum(met) - 1).astype(np.int32)
    parts = [Chunk(rows[x], weight[x], place) for x in chunks(rows, chunk_features)]
    params = [np.zeros(1, np.float32), np.zeros(len(seen), np.float32),
              rng.normal(0, 0.02, (len(seen), FACTORS)).astype(np.float32)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        grads = [np.zeros(p.shape) for p in params]
        for part in parts:
            part.add_gradient(params, grads)
        grads[1] += DECAY * params[1]
        grads[2] += DECAY * params[2]
        for p, d, a, b in zip(params, grads, first, second):
            a += 0.1 * (d - a)
            b += 0.001 * (d * d - b)
            p -= RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    linear, factors = np.zeros(N_FEATURES, np.float32), np.zeros((N_FEATURES, FACTORS), np.float32)
    linear[seen], factors[seen] = params[1], params[2]
    return FactorisationMachine(float(params[0][0] + np.log(share / (1 - share))), linear, factors)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1):
        index, value = [], []
        for raw, declared in zip(batch.column(1), batch.column(2).to_pylist()):
            i, v = features(raw.as_py(), declared)
            index.append(i.astype("<i4").tobytes())
            value.append(v.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index, pa.binary()), pa.array(value, pa.binary())],
                                         ["y", "index", "value"])


def _text_and_length(docs: DataFrame) -> list:
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return [text_bytes(F.col("text")).alias("text"), length.alias("n_chars")]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS
          ) -> FactorisationMachine:
    rows = label_rows(labels, label, HOLD_MODULUS, HOLD_REMAINDER)
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < n:
        share = ones / n if n else 0.5
        return constant(share)
    narrow = small_batches(docs).select("doc_id", *_text_and_length(docs))
    picked = sample(narrow, rows, per_class, ["text", "n_chars"]).select("y", "text", "n_chars")
    found = [(r.y, bytes(r["index"]), bytes(r.value)) for r in
             picked.mapInArrow(_featured, "y int, index binary, value binary").collect()]
    if len({r[0] for r in found}) < 2:  # the labelled documents of a class are missing
        return constant(ones / n)
    found.sort(key=lambda r: (r[0], len(r[1]), r[1], r[2]))  # whatever order the tasks ended in
    return fit([(y, np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4")) for y, i, v in found], ones / n)


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in sliced(batches, 1):
        scores = [model.score(*features(raw.as_py(), declared))
                  for raw, declared in zip(batch.column(1), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label))
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), *_text_and_length(docs))
    out = rows.mapInArrow(lambda it: _scored(it, shared), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), HOLD_MODULUS, HOLD_REMAINDER).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, unchanged: a narrow filter."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label))
    text, length = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            declared = batch.column(length).to_pylist() if length is not None else [None] * batch.num_rows
            mask = [model.score(*features(raw.as_py() or b"", n)) >= threshold
                    for raw, n in zip(batch.column(text).cast(pa.binary()), declared)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return filter_batches(small_batches(docs), keep)
