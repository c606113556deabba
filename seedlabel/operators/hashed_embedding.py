"""Sentence embeddings without a trained encoder: weighted hashed projections.

A word is a vector of +-1 signs read off its digest; a sentence is the mean of
its words' vectors, weighted by ``a / (a + p(w))`` so that frequent words count
little.  What all sentences share, the first principal direction, is removed
afterwards: the second moments (dims x dims numbers) are summed per task, and
only they reach the driver.

The weights of the ``head`` most frequent words are sent to the tasks (a bounded
table); every rarer word has p below theirs and takes weight 1.  As an encoder
the projection plugs into :mod:`embedding_cache`; the direction depends on the
corpus and is removed after the cache is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 64
A = 1e-3
HEAD = 32768


def word_weights(sent: DataFrame, tokens_col: str = "tokens", a: float = A) -> DataFrame:
    """``(word, n, weight)`` of every word."""
    counts = sent.select(F.explode(tokens_col).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.select("word", "n", (F.lit(a) / (F.lit(a) + F.col("n").cast("double") / total)).alias("weight"))


def head_weights(weights: DataFrame, head: int = HEAD) -> dict[str, float]:
    """Weights of the ``head`` most frequent words (a bounded table)."""
    return {r["word"]: r["weight"] for r in weights.orderBy(F.desc("n"), "word").limit(head).collect()}


def word_signs(words: list[str], dims: int = DIMS) -> np.ndarray:
    """+-1 by the bits of the words' SHA-512 digests (dims up to 512)."""
    raw = b"".join(hashlib.sha512(w.encode()).digest()[:-(-dims // 8)] for w in words)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(len(words), -1)[:, :dims]
    return bits.astype(np.float64) * 2.0 - 1.0


def encoder(weights: dict[str, float], dims: int = DIMS):
    """An encoder for :mod:`embedding_cache`: texts (tokens joined by blanks) to
    vectors.  A text without tokens is the zero vector."""
    def encode(texts: pd.Series) -> np.ndarray:
        tokens = [t.split() for t in texts]
        words, which = np.unique([w for t in tokens for w in t] or [""], return_inverse=True)
        w = np.array([weights.get(x, 1.0) for x in words])
        vectors = word_signs(words.tolist(), dims) * w[:, None] / np.sqrt(dims)
        out, at = np.zeros((len(tokens), dims)), 0
        for i, t in enumerate(tokens):
            if t:
                out[i] = vectors[which[at:at + len(t)]].mean(axis=0)
                at += len(t)
        return out
    return encode


def first_direction(vectors: DataFrame, col: str = "embedding", dims: int = DIMS) -> np.ndarray:
    """The unit vector along which the rows' second moment is largest (its largest entry positive)."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], ["i", "v"])

    sums = (vectors.select(col).mapInArrow(moments, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))).toArrow()
    moment = np.zeros(dims * dims)
    moment[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
    u = np.linalg.eigh(moment.reshape(dims, dims))[1][:, -1]
    return u * (1.0 if u[np.argmax(np.abs(u))] >= 0 else -1.0)


def without_direction(vectors: DataFrame, u: np.ndarray, col: str = "embedding") -> DataFrame:
    """Every vector less its projection on ``u`` (array expressions only)."""
    unit = F.array(*[F.lit(float(x)) for x in u])
    dot = F.aggregate(F.zip_with(col, unit, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return (vectors.withColumn("_dot", dot)
            .withColumn(col, F.zip_with(col, unit, lambda a, b: a - F.col("_dot") * b)).drop("_dot"))
