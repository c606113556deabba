"""Vectorised bag-of-words cosine scoring inside Arrow batches.

Arrow-native UDFs: a batch of ``list<string>`` token arrays arrives as a
pyarrow array, is flattened and dictionary-encoded by Arrow (no Python
string objects), and
  * the squared bag norm of every sentence comes from one bincount over
    (sentence, word) pairs,
  * the dot product with every weighted bag comes from a bincount over the
    tokens that occur in some bag (all other tokens are skipped).
No per-token Python loop runs; the work is linear in the batch's tokens.
The bags are a bounded parameter (seed texts, chosen representatives) and
are shipped with the function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BagScorer:
    def __init__(self, bags: list[dict[str, float]], groups: list[list[int]] | None = None):
        vocab = sorted({w for b in bags for w in b})
        self.index = pd.Index(vocab, dtype=object)
        self.vocab_arrow = pa.array(vocab, type=pa.string())
        self.W = np.zeros((len(vocab) + 1, len(bags)))          # last row: words in no bag
        for j, b in enumerate(bags):
            for w, v in b.items():
                self.W[self.index.get_loc(w), j] = v
        self.qn = np.sqrt((self.W ** 2).sum(axis=0))
        self.groups = groups

    def cosines(self, token_lists) -> np.ndarray:
        """(n_sentences, n_bags) cosine matrix for a sequence of token arrays."""
        n = len(token_lists)
        nb = self.W.shape[1]
        lens = np.fromiter((len(t) for t in token_lists), dtype=np.int64, count=n)
        if n == 0 or lens.sum() == 0:
            return np.zeros((n, nb))
        flat = np.concatenate([np.asarray(t, dtype=object) for t in token_lists if len(t)])
        sid = np.repeat(np.arange(n), lens)
        codes, uniq = pd.factorize(flat)
        return self._cosines(n, sid, codes.astype(np.int64), len(uniq), self.index.get_indexer(uniq))

    def cosines_arrow(self, tokens: pa.Array) -> np.ndarray:
        """Same as :meth:`cosines` for an Arrow ``list<string>`` array: the
        tokens are dictionary-encoded in Arrow, no Python string objects."""
        if isinstance(tokens, pa.ChunkedArray):
            tokens = tokens.combine_chunks()
        n = len(tokens)
        offsets = tokens.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        lens = np.diff(offsets)
        lens[tokens.is_null().to_numpy(zero_copy_only=False)] = 0
        if n == 0 or lens.sum() == 0:
            return np.zeros((n, self.W.shape[1]))
        flat = tokens.flatten()
        enc = pc.dictionary_encode(flat).combine_chunks() if isinstance(flat, pa.ChunkedArray) else \
            pc.dictionary_encode(flat)
        codes = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        vidx = pc.index_in(enc.dictionary, value_set=self.vocab_arrow).fill_null(-1)
        sid = np.repeat(np.arange(n), lens)
        return self._cosines(n, sid, codes, len(enc.dictionary), vidx.to_numpy(zero_copy_only=False).astype(np.int64))

    def _cosines(self, n: int, sid: np.ndarray, codes: np.ndarray, nu: int, vidx: np.ndarray) -> np.ndarray:
        """Core: ``sid``/``codes`` per token, ``vidx`` maps a distinct token
        to its row in the bag matrix (-1 when in no bag)."""
        nb = self.W.shape[1]
        pair, cnt = np.unique(sid * nu + codes, return_counts=True)
        ss = np.bincount(pair // nu, weights=cnt.astype(np.float64) ** 2, minlength=n)
        hit = vidx[codes] >= 0
        dots = np.zeros((n, nb))
        if hit.any():
            rows = self.W[vidx[codes[hit]]]
            s_hit = sid[hit]
            for j in range(nb):
                dots[:, j] = np.bincount(s_hit, weights=rows[:, j], minlength=n)
        den = np.sqrt(ss)[:, None] * self.qn[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            cos = np.where(den > 0, dots / np.where(den > 0, den, 1.0), 0.0)
        return cos

    def grouped(self, cos: np.ndarray) -> np.ndarray:
        if self.groups is None:
            return cos
        out = np.zeros((cos.shape[0], len(self.groups)))
        for g, cols in enumerate(self.groups):
            if cols:
                out[:, g] = cos[:, cols].max(axis=1)
        return out


def _list_of_doubles(m: np.ndarray) -> pa.Array:
    n, k = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)),
                                    pa.array(m.ravel(), type=pa.float64()))


def bag_scores(bags: list[dict[str, float]], groups: list[list[int]] | None = None):
    """Arrow UDF: token array -> array of cosines (one per bag, or per group
    = max over the group's bags)."""
    scorer = BagScorer(bags, groups)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(tokens: pa.Array) -> pa.Array:
        return _list_of_doubles(scorer.grouped(scorer.cosines_arrow(tokens)))

    return score


def doc_bag_sums(bags: list[dict[str, float]]):
    """pandas UDF: array of sentence token arrays (one document) -> per bag,
    the sum over the document's sentences of the sentence cosine."""
    scorer = BagScorer(bags)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(docs: pa.Array) -> pa.Array:
        if isinstance(docs, pa.ChunkedArray):
            docs = docs.combine_chunks()
        n = len(docs)
        offsets = docs.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.diff(offsets)
        counts[docs.is_null().to_numpy(zero_copy_only=False)] = 0
        sents = docs.flatten()
        cos = scorer.cosines_arrow(sents)
        did = np.repeat(np.arange(n), counts)
        out = np.zeros((n, cos.shape[1]))
        for j in range(cos.shape[1]):
            out[:, j] = np.bincount(did, weights=cos[:, j], minlength=n)
        return _list_of_doubles(out)

    return score
