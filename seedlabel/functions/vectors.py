"""Vector helpers.

Wide-vector scoring runs in numpy inside an Arrow-native UDF: the batch's
``list<float>`` column is read as one flat values buffer, reshaped to a
matrix and multiplied with all prototypes at once (one BLAS matmul per
batch).  Small per-row vector maths uses Spark higher-order functions so it
stays in the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either side is the zero vector."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


def stack_column(s: pd.Series, dim: int | None = None) -> np.ndarray:
    """Arrow list column -> (n, d) float64 matrix."""
    if len(s) == 0:
        return np.zeros((0, dim or 0))
    return np.vstack(s.to_numpy()).astype(np.float64)


def _dense_matrix(vecs, dim: int) -> np.ndarray:
    """Arrow ``list<float>`` array -> (n, dim) float64 matrix from the flat
    values buffer (no per-row objects).  Null rows are zero (the caller gives
    them a null result); any other length than ``dim`` is an error."""
    if isinstance(vecs, pa.ChunkedArray):
        vecs = vecs.combine_chunks()
    n = len(vecs)
    offsets = vecs.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    lens = np.diff(offsets)
    nulls = vecs.is_null().to_numpy(zero_copy_only=False)
    values = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and not nulls.any() and (lens == dim).all():
        return values.reshape(n, dim)
    wrong = lens[~nulls][lens[~nulls] != dim]
    if len(wrong):
        raise ValueError(f"a vector has {wrong[0]} dimensions, the prototypes have {dim}")
    out = np.zeros((n, dim))
    out[~nulls] = values.reshape(-1, dim)
    return out


def multi_set_scorer_udf(sets: list[tuple[np.ndarray, np.ndarray, int]], keep_scores: bool = False):
    """One Arrow UDF for several prototype sets: ONE matmul of the batch
    against all prototypes stacked, then per set the per-class max and the
    first best class.  Returns struct(cls array<int>, score array<double>
    [, scores array<array<double>>]) with one entry per set; null for a null
    vector."""
    mats = [unit_rows(m.astype(np.float64)) for m, _, _ in sets]
    allp = np.vstack(mats) if mats else np.zeros((0, 0))
    offsets = np.cumsum([0] + [m.shape[0] for m in mats])
    fields = [T.StructField("cls", T.ArrayType(T.IntegerType())), T.StructField("score", T.ArrayType(T.DoubleType()))]
    if keep_scores:
        fields.append(T.StructField("scores", T.ArrayType(T.ArrayType(T.DoubleType()))))
    schema = T.StructType(fields)
    n_sets = len(sets)

    def lists(m: np.ndarray, typ) -> pa.Array:
        n, k = m.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)),
                                        pa.array(m.ravel(), type=typ))

    @F.arrow_udf(schema)
    def score(vecs: pa.Array) -> pa.Array:
        if isinstance(vecs, pa.ChunkedArray):
            vecs = vecs.combine_chunks()
        m = _dense_matrix(vecs, allp.shape[1])
        n = len(m)
        sims = unit_rows(m) @ allp.T if n else np.zeros((0, allp.shape[0]))
        cls_m = np.zeros((n, n_sets), dtype=np.int32)
        score_m = np.zeros((n, n_sets))
        per_sets = []
        for j, (_, classes, k) in enumerate(sets):
            block = sims[:, offsets[j]:offsets[j + 1]]
            per_class = np.full((n, k), -np.inf)
            for c in range(k):
                sel = classes == c
                if sel.any():
                    per_class[:, c] = block[:, sel].max(axis=1)
            best = per_class.argmax(axis=1) if n else np.zeros(0, dtype=np.int64)
            cls_m[:, j] = best
            score_m[:, j] = per_class[np.arange(n), best] if n else 0.0
            per_sets.append(per_class)
        arrays = [lists(cls_m, pa.int32()), lists(score_m, pa.float64())]
        names = ["cls", "score"]
        if keep_scores:
            # row-major: row i holds set 0's k_0 scores, then set 1's k_1, ...
            ks = np.array([ps.shape[1] for ps in per_sets], dtype=np.int64)
            values = np.hstack(per_sets).ravel() if n else np.zeros(0)
            inner_off = np.concatenate([[0], np.cumsum(np.tile(ks, n))]).astype(np.int32)
            inner = pa.ListArray.from_arrays(pa.array(inner_off), pa.array(values, type=pa.float64()))
            arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(0, n * n_sets + 1, n_sets, dtype=np.int32)),
                                                   inner))
            names.append("scores")
        return pa.StructArray.from_arrays(arrays, names=names, mask=vecs.is_null())

    return score
