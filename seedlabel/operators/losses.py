"""Loss values over class logits: softmax, focal loss, generalised
cross-entropy, plain cross-entropy, inverse-count class weights.

Per-row maths is higher-order functions over the logits array; the mean is
one global aggregate (partial per task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def log_softmax_at(logits, target) -> Column:
    """log p_target under softmax(logits), shifted by the max for stability."""
    lg, y = _c(logits), _c(target)
    m = F.array_max(lg)
    lse = F.log(F.aggregate(lg, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))) + m
    return F.element_at(lg, y + 1) - lse


def softmax(logits) -> Column:
    lg = _c(logits)
    m = F.array_max(lg)
    e = F.transform(lg, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def focal_terms(logits, target, gamma: float, alpha=None) -> Column:
    """-(1 - p_y)^gamma * alpha_y * log p_y (alpha: optional array column of class weights)."""
    lp = log_softmax_at(logits, target)
    term = -F.pow(1 - F.exp(lp), F.lit(float(gamma))) * lp
    if alpha is not None:
        term = term * F.element_at(_c(alpha), _c(target) + 1)
    return term


def focal_loss(df: DataFrame, logits: str, target: str, gammas: list[float], digits: int = 6,
               reduce: str = "mean") -> DataFrame:
    """One row per gamma: the mean (or sum) focal loss; gamma = 0 is cross-entropy."""
    agg = F.avg if reduce == "mean" else F.sum
    row = df.agg(*[agg(focal_terms(logits, target, g)).alias(f"g{i}") for i, g in enumerate(gammas)])
    pts = F.array(*[F.struct(F.lit(float(g)).alias("gamma"), F.round(F.col(f"g{i}"), digits).alias("loss"))
                    for i, g in enumerate(gammas)])
    return row.select(F.inline(pts))


def cross_entropy(df: DataFrame, logits: str, target: str, digits: int = 6) -> DataFrame:
    return df.agg(F.round(F.avg(-log_softmax_at(logits, target)), digits).alias("loss"))


def class_weights(counts: DataFrame, cls_col: str = "cls", n_col: str = "n") -> DataFrame:
    """softmax(log(1/n_c)) = (1/n_c) / sum_j (1/n_j), not rounded."""
    inv = F.try_divide(F.lit(1.0), F.col(n_col).cast("double"))
    return counts.select(cls_col, n_col, (inv / F.sum(inv).over(Window.partitionBy())).alias("weight"))


def gce_loss(df: DataFrame, logits: str, target: str, q: float, weights: Column, alpha: float = 0.0,
             digits: int = 6) -> DataFrame:
    """(mean(alpha * lq + (1 - alpha) * lq * w_y))^2 with lq = (1 - p_y^q) / q.

    ``weights`` is a column holding either an array of per-class weights
    (index = class) or a map class -> weight (e.g. a scalar subquery over
    :func:`class_weights`); a class without a weight weighs 0, its rows count."""
    from pyspark.sql.types import ArrayType
    p = F.exp(log_softmax_at(logits, target))
    lq = (1 - F.pow(p, F.lit(q))) / F.lit(q)
    withw = df.withColumn("_w", weights)
    is_array = isinstance(withw.schema["_w"].dataType, ArrayType)
    w = F.coalesce(F.try_element_at(F.col("_w"), F.col(target) + (1 if is_array else 0)), F.lit(0.0))
    return (withw
            .agg(F.avg(F.lit(alpha) * lq + F.lit(1 - alpha) * lq * w).alias("m"))
            .select(F.lit(float(q)).alias("q"), F.round(F.col("m") * F.col("m"), digits).alias("loss")))
