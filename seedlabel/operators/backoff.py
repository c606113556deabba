"""Substitutes from a two-sided n-gram model with back-off.

A context that occurs once offers only its own word when substitutes are read
off exact contexts.  Here every position gets the K likeliest words under an
interpolated model of its left and right neighbours:

    P(w | l, r) = e(w | l, r) + m(l, r) * (L(w | l) + R(w | r)) / 2
    L(w | l)    = a(w | l) + m(l) * C(w)            (R alike)

``e`` and ``a`` are absolutely discounted relative counts, (n - D) / total, of
the ``entries`` most frequent words of the context (a pruned model: other words
are left to the back-off); ``m`` is the mass that this leaves, and ``C(w)``, the
continuation probability, is the share of distinct neighbours that ``w`` has.

Everything is count tables and joins: the exact counts by (left, word, right)
are written once, the one-sided counts, totals and neighbour counts are
aggregates of them, and each context is joined to one bounded row of entries
per neighbour (so a neighbour with a large share of all contexts is split like
any skewed join).  The best words of a context are found in Arrow batches among
its at most ``3 * entries`` entries and the words of highest continuation
probability, of which ``k + 3 * entries`` suffice: any other word is less
probable than ``k`` of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.operators.packed import in_byte_order
from seedlabel.operators.prototypes import top_k_per_group
from seedlabel.operators.vocabulary import context_fillers
from seedlabel.session import broadcast_if_bounded, written_table

DISCOUNT = 0.75
ENTRIES = 10
#: Contexts of a work array.
ROWS = 4096
#: Decimal places of a probability (ties after rounding go by word).
PLACES = 12

_LIST = "array<struct<w:string,x:double,c:double>>"


def _entries(counts: DataFrame, keys: list[str], entries: int, discount: float, continuation: DataFrame) -> DataFrame:
    """``(*keys, list, rest)`` of ``(*keys, word, n)``: the bounded entries of
    every context, most frequent first, and the mass they leave."""
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    top = top_k_per_group(counts, keys, [F.desc("n"), F.asc("word")], entries, rank_col="rank").join(continuation, "word")
    struct = F.struct("rank", F.col("word").alias("w"), F.col("n").alias("n"), "c")
    lists = top.groupBy(*keys).agg(F.sort_array(F.collect_list(struct)).alias("s"))  # at most ``entries`` structs
    full = lists.join(totals, keys)
    plain = F.transform("s", lambda e: F.struct(e["w"].alias("w"), ((e["n"] - F.lit(discount)) / F.col("total")).alias("x"),
                                                e["c"].alias("c")))
    rest = F.lit(1.0) - F.aggregate("list", F.lit(0.0), lambda a, e: a + e["x"])
    return full.select(*keys, plain.alias("list")).withColumn("rest", rest)


class BackoffModel:
    """The count tables of the model, from token positions ``(left, token, right)``."""

    def __init__(self, positions: DataFrame, entries: int = ENTRIES, discount: float = DISCOUNT):
        self.entries, self.discount = entries, discount
        # a sentence without tokens has a position without a token
        self.exact = written_table(context_fillers(positions.filter(F.col("token").isNotNull())), "backoff-counts")
        one_left = written_table(self.exact.groupBy("left", "word").agg(F.sum("n").alias("n")), "backoff-left")
        one_right = written_table(self.exact.groupBy("right", "word").agg(F.sum("n").alias("n")), "backoff-right")
        kinds = (one_left.select("word").unionByName(one_right.select("word"))
                 .groupBy("word").agg(F.count(F.lit(1)).alias("kinds")))
        kinds = written_table(kinds, "backoff-kinds")
        total = kinds.agg(F.sum("kinds").alias("t")).scalar()
        words = kinds.select("word", (F.col("kinds").cast("double") / total).alias("c"))
        self.continuation = broadcast_if_bounded(words, kinds.count(), row_bytes=40)
        self.left = _entries(one_left, ["left"], entries, discount, self.continuation)
        self.right = _entries(one_right, ["right"], entries, discount, self.continuation)

    def contexts(self) -> DataFrame:
        """``(left, right, exact, rest)``: every distinct context with its exact entries."""
        return (_entries(self.exact, ["left", "right"], self.entries, self.discount, self.continuation)
                .withColumnsRenamed({"list": "exact"}))

    def top(self, contexts: DataFrame, k: int) -> DataFrame:
        """``(left, right, word, p, rank)``: the k likeliest words of ``contexts``
        (rows of :meth:`contexts`), rank from 1."""
        joined = (contexts.join(self.left.select("left", F.col("list").alias("l_list"), F.col("rest").alias("l_rest")), "left")
                  .join(self.right.select("right", F.col("list").alias("r_list"), F.col("rest").alias("r_rest")), "right")
                  .select("left", "right", "exact", "l_list", "r_list", "rest", "l_rest", "r_rest"))
        common = [(r["word"], r["c"]) for r in self.continuation.orderBy(F.desc("c"), "word")
                  .limit(k + 3 * self.entries).collect()]
        return joined.mapInArrow(lambda it: _best(it, common, k),
                                 "left string, right string, word string, p double, rank int")


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(row of every entry, words, x, c) of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    entries = column.flatten()
    return (np.repeat(np.arange(len(column)), sizes), entries.field("w"),
            entries.field("x").to_numpy(zero_copy_only=False), entries.field("c").to_numpy(zero_copy_only=False))


def _best(batches: Iterator[pa.RecordBatch], common: list[tuple[str, float]], k: int) -> Iterator[pa.RecordBatch]:
    names = pa.array([w for w, _ in common], pa.string())
    common_c = np.array([c for _, c in common])
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):  # bounds the work arrays
            batch = whole.slice(at, ROWS)
            n = batch.num_rows
            rest, l_rest, r_rest = (batch.column(i).to_numpy() for i in (5, 6, 7))
            half = rest / 2
            mass = half * (l_rest + r_rest)
            parts = [_flat(batch.column(i)) for i in (2, 3, 4)]
            scale = (np.ones(n), half, half)
            rows = np.concatenate([p[0] for p in parts])
            x = np.concatenate([p[2] * s[p[0]] for p, s in zip(parts, scale)])
            c = np.concatenate([p[3] for p in parts])
            distinct, code = in_byte_order(pa.concat_arrays([*(p[1].cast(pa.string()) for p in parts), names]))
            code, common_code = code[:len(rows)], code[len(rows):]
            keys, first, inverse = np.unique(rows * len(distinct) + code, return_index=True, return_inverse=True)
            row, word = keys // len(distinct), keys % len(distinct)
            p = np.round(np.bincount(inverse, x, len(keys)) + mass[row] * c[first], PLACES)
            # a row's common words without an entry; below the k-th of them nothing is chosen
            number = np.full(len(distinct), -1)
            number[common_code] = np.arange(len(common))
            absent = np.ones((n, len(common)), bool)
            known = number[word] >= 0
            absent[row[known], number[word[known]]] = False
            common_p = np.round(mass[:, None] * common_c, PLACES)
            last = absent & (np.cumsum(absent, axis=1) == k)
            cut = np.where(last.any(axis=1), np.where(last, common_p, 0.0).sum(axis=1), -1.0)
            kept = p >= cut[row]
            more, which = np.nonzero(absent & (common_p >= cut[:, None]))
            row, word = np.concatenate([row[kept], more]), np.concatenate([word[kept], common_code[which]])
            p = np.concatenate([p[kept], common_p[more, which]])
            by = np.lexsort((word, -p, row))  # within a row by falling p, then by word
            row = row[by]
            rank = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row] + 1
            kept = rank <= k
            chosen, row = by[kept], row[kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)),
                 distinct.take(pa.array(word[chosen])), pa.array(p[chosen]), pa.array(rank[kept].astype(np.int32))],
                ["left", "right", "word", "p", "rank"])


def backoff_substitutes(positions: DataFrame, k: int, entries: int = ENTRIES, discount: float = DISCOUNT) -> DataFrame:
    """The k likeliest words of every distinct context of ``positions``."""
    model = BackoffModel(positions, entries, discount)
    return model.top(model.contexts(), k)
