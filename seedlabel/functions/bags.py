"""Bag-of-words vectors as expressions over a token array (JVM-only form).

A sentence's bag is never materialised: the dot product with a small
weighted word bag is one pass over the tokens with map lookups, and the
sentence norm one pass over the sorted tokens -- higher-order functions,
per row, no shuffle, no Python.  They suit a handful of tiny bags; for many
or larger bags :mod:`seedlabel.functions.bag_udf` (vectorised per Arrow
batch) is the faster path and is what the labelers use.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def count_of(tokens, word: str) -> Column:
    """Occurrences of ``word`` in the token array."""
    return F.size(F.filter(_c(tokens), lambda t: t == F.lit(word)))


def sum_sq_counts(tokens) -> Column:
    """sum over distinct words of count(word)^2 (the squared bag norm).

    Scans the sorted tokens once; a run of r equal tokens adds
    1 + 3 + ... + (2r-1) = r^2.
    """
    init = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).cast("long").alias("run"),
                    F.lit(0).cast("long").alias("acc"))

    def step(s, t):
        same = s["prev"].eqNullSafe(t)
        return F.when(same, F.struct(t.alias("prev"), (s["run"] + 1).alias("run"),
                                     (s["acc"] + 2 * s["run"] + 1).alias("acc"))) \
            .otherwise(F.struct(t.alias("prev"), F.lit(1).cast("long").alias("run"), (s["acc"] + 1).alias("acc")))

    return F.aggregate(F.array_sort(_c(tokens)), init, step, lambda s: s["acc"])


def bag_weights(words: list[str]) -> dict[str, float]:
    """A word list (e.g. the seed words of a class joined into one text) as a count bag."""
    out: dict[str, float] = {}
    for w in words:
        out[w] = out.get(w, 0.0) + 1.0
    return out


def bag_dot(tokens, weights: dict[str, float]) -> Column:
    """sum over tokens of weights[token] = <sentence bag, weights>."""
    if not weights:
        return F.lit(0.0)
    m = F.create_map(*[x for w, v in sorted(weights.items()) for x in (F.lit(w), F.lit(float(v)))])
    return F.aggregate(_c(tokens), F.lit(0.0), lambda acc, t: acc + F.coalesce(F.try_element_at(m, t), F.lit(0.0)))


def bag_cosine(tokens, weights: dict[str, float], sent_norm: Column | None = None) -> Column:
    """Cosine between the sentence's bag and ``weights``; 0 for an empty side."""
    qn = math.sqrt(sum(v * v for v in weights.values()))
    sn = sent_norm if sent_norm is not None else F.sqrt(sum_sq_counts(tokens).cast("double"))
    den = sn * F.lit(qn)
    return F.when(den > 0, bag_dot(tokens, weights) / den).otherwise(F.lit(0.0))


def argmax_first(arr) -> Column:
    """0-based index of the first maximum of a non-empty double array."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
