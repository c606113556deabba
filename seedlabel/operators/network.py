"""A text classifier with one hidden layer, trained by back-propagation.

Texts become hashed bags of words: share of a text's tokens per bucket, the
bucket taken from the token's MD5 digest.  Each full-batch step is one pass over
the written features: a task runs its rows forward and back through both layers
and yields its partial gradient (hidden x (dims + 1) + classes x (hidden + 1)
numbers), one small aggregate adds them, and the driver applies the step with
momentum.  The starting weights are hashes of their places, so any engine can
recompute them.

A text without tokens has no features; the biases alone decide its class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.session import written_table

DIMS = 128
HIDDEN = 16
MOMENTUM = 0.9
#: Rows of a dense work array.
ROWS = 4096


@dataclass
class Network:
    inner: np.ndarray   # (hidden, dims + 1), last column the bias
    outer: np.ndarray   # (classes, hidden + 1), last column the bias
    history: list = field(default_factory=list)  # (loss, accuracy) before each step


def _hash32(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def hashed_weights(name: str, rows: int, cols: int) -> np.ndarray:
    """Weights in [-1, 1) from the hash of their place, with a bias column of zeros."""
    w = [[_hash32(f"{name}:{i}:{j}") / 4294967296.0 * 2 - 1 for j in range(cols)] + [0.0] for i in range(rows)]
    return np.array(w)


def hashed_features(df: DataFrame, tokens_col: str, keep: list[str], dims: int = DIMS) -> DataFrame:
    """``(*keep, bucket array<int>, share array<double>)``: a text's buckets,
    ascending, with their shares of its tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            n = len(column)
            coded = column.flatten().dictionary_encode()
            bucket = np.array([_hash32(w) % dims for w in coded.dictionary.to_pylist()], np.int64)
            row = np.repeat(np.arange(n), np.diff(column.offsets.to_numpy()))
            keys, count = np.unique(row * dims + bucket[coded.indices.to_numpy(zero_copy_only=False)] if len(row)
                                    else np.zeros(0, np.int64), return_counts=True)
            at = keys // dims
            size = np.bincount(row, minlength=n)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array((keys % dims).astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(count / size[at] if len(at) else np.zeros(0)))],
                [*batch.schema.names[:-1], "bucket", "share"])

    rows = df.select(*keep, F.coalesce(F.col(tokens_col), F.array().cast("array<string>")).alias("_tokens"))
    kept = [f"`{c}` {t}" for c, t in rows.dtypes[:-1]]
    return rows.mapInArrow(run, ", ".join([*kept, "bucket array<int>", "share array<double>"]))


def _dense(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    bucket, share = batch.column("bucket"), batch.column("share")
    x = np.zeros((batch.num_rows, dims))
    row = np.repeat(np.arange(batch.num_rows), np.diff(bucket.offsets.to_numpy()))
    x[row, bucket.flatten().to_numpy(zero_copy_only=False)] = share.flatten().to_numpy(zero_copy_only=False)
    return x


def forward(x: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden activations, logits)."""
    a = np.tanh(x @ inner[:, :-1].T + inner[:, -1])
    return a, a @ outer[:, :-1].T + outer[:, -1]


def gradients(x: np.ndarray, y: np.ndarray, inner: np.ndarray, outer: np.ndarray):
    """(inner gradient, outer gradient, loss, correct) summed over rows."""
    a, z = forward(x, inner, outer)
    z = z - z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    here = np.arange(len(y))
    loss, correct = -np.log(np.maximum(p[here, y], 1e-300)).sum(), (p.argmax(axis=1) == y).sum()
    p[here, y] -= 1.0
    back = (p @ outer[:, :-1]) * (1.0 - a * a)
    return (np.column_stack([back.T @ x, back.sum(axis=0)]), np.column_stack([p.T @ a, p.sum(axis=0)]),
            float(loss), float(correct))


def train(features: DataFrame, label_col: str, n_classes: int, hidden: int = HIDDEN, iters: int = 8, step: float = 1.0,
          dims: int = DIMS, momentum: float = MOMENTUM) -> Network:
    """Full-batch training on ``(label, bucket, share)`` rows, written once."""
    rows = written_table(features.select(F.col(label_col).cast("int").alias("y"), "bucket", "share"), "network-features")
    net = Network(hashed_weights("hidden", hidden, dims), hashed_weights("out", n_classes, hidden))
    speed = [np.zeros_like(net.inner), np.zeros_like(net.outer)]
    for _ in range(iters):
        inner, outer = net.inner, net.outer

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(inner.size + outer.size + 3)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    gi, go, loss, correct = gradients(_dense(part, dims), part.column("y").to_numpy(), inner, outer)
                    total += np.concatenate([gi.ravel(), go.ravel(), [loss, correct, part.num_rows]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

        sums = rows.mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(inner.size + outer.size + 3)
        flat[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
        loss, correct, n = flat[-3:]
        n = max(n, 1.0)
        net.history.append((loss / n, correct / n))
        grads = flat[:inner.size].reshape(inner.shape), flat[inner.size:-3].reshape(outer.shape)
        speed = [momentum * v - step * g / n for v, g in zip(speed, grads)]
        net.inner, net.outer = inner + speed[0], outer + speed[1]
    return net


def predict(features: DataFrame, net: Network, keep: list[str], out_col: str = "pred") -> DataFrame:
    """``(*keep, pred)``: the class of the largest logit, map-only."""
    inner, outer = net.inner, net.outer
    dims = inner.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                label = forward(_dense(part, dims), inner, outer)[1].argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(label)], [*keep, out_col])

    rows = features.select(*keep, "bucket", "share")
    kept = [f"`{c}` {t}" for c, t in rows.dtypes[:-2]]
    return rows.mapInArrow(run, ", ".join([*kept, f"{out_col} int"]))
