"""Confidence thresholds over scored rows: plain, class-relaxed, grid, quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_confident(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Rows whose every score column reaches its threshold (``>=``)."""
    cond = F.lit(True)
    for col, t in thresholds.items():
        cond = cond & (F.col(col) >= F.lit(t))
    return df.filter(cond)


def keep_confident_relaxed(df: DataFrame, thresholds: dict[str, float], class_col: str,
                           relax: dict[int, float]) -> DataFrame:
    """Like :func:`keep_confident`, but rows whose ``class_col`` is in ``relax``
    get every threshold lowered by that class's amount."""
    delta = F.lit(0.0)
    for cls, d in relax.items():
        delta = F.when(F.col(class_col) == F.lit(cls), F.lit(d)).otherwise(delta)
    cond = F.lit(True)
    for col, t in thresholds.items():
        cond = cond & (F.col(col) >= F.lit(t) - delta)
    return df.filter(cond)


def threshold_grid(df: DataFrame, score_cols: tuple[str, str], grid: list[tuple[float, float]],
                   label_cols=("aspect", "polarity")) -> DataFrame:
    """Label counts for every threshold pair of ``grid`` in ONE scan.

    Each grid point becomes a conditional count in a single partial
    aggregate grouped by the label columns (no join with the grid), then
    the counts are unpivoted to ``(t1, t2, *labels, n)``; zero counts are
    dropped.
    """
    a, b = score_cols
    aggs = [F.count_if((F.col(a) >= F.lit(t1)) & (F.col(b) >= F.lit(t2))).alias(f"g{i}")
            for i, (t1, t2) in enumerate(grid)]
    wide = df.groupBy(*label_cols).agg(*aggs)
    points = F.array(*[F.struct(F.lit(float(t1)).alias("t1"), F.lit(float(t2)).alias("t2"),
                                F.col(f"g{i}").cast("long").alias("n")) for i, (t1, t2) in enumerate(grid)])
    return (wide.select(*label_cols, F.inline(points))
            .filter(F.col("n") > 0)
            .select(F.col("t1").alias(f"{a}_threshold"), F.col("t2").alias(f"{b}_threshold"), *label_cols, "n"))


def exact_quantiles(df: DataFrame, value_col: str, groups, qs: list[float], digits: int = 6,
                    interpolate: bool = True) -> DataFrame:
    """Exact linear-interpolated quantiles of ``round(value, digits)`` per group.

    Values are first reduced to a histogram (``groupBy(groups, value).count()``,
    combined map-side), whose size per group is bounded by the number of
    distinct rounded values, not by the row count; ranks are then found by a
    running sum over that histogram.  Same definition as the continuous
    quantile: position h = (n-1)q, interpolate between ranks floor(h), ceil(h).
    With ``interpolate=False`` the discrete quantile (SQL PERCENTILE_DISC):
    the first value whose cumulative count reaches q * n.
    """
    g = list(groups)
    v = F.round(F.col(value_col), digits).alias("v")
    hist = df.groupBy(*g, v).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*g).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("cum", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*g)))
    out = None
    for q in qs:
        if not interpolate:
            part = hist.groupBy(*g).agg(F.min(F.when(F.col("cum") >= F.col("n") * F.lit(q), F.col("v"))).alias("x"))
            part = part.select(*g, F.lit(q).alias("q"), F.col("x").alias(f"{value_col}_quantile"))
            out = part if out is None else out.unionByName(part)
            continue
        h = (F.col("n") - 1) * F.lit(q)
        lo = F.floor(h)
        hi = F.ceil(h)
        part = hist.groupBy(*g).agg(
            F.first("n").alias("n"),
            F.min(F.when(F.col("cum") >= lo + 1, F.col("v"))).alias("lo_v"),
            F.min(F.when(F.col("cum") >= hi + 1, F.col("v"))).alias("hi_v"),
            F.first(h - lo).alias("frac"))
        part = part.select(*g, F.lit(q).alias("q"),
                           F.round(F.col("lo_v") + (F.col("hi_v") - F.col("lo_v")) * F.col("frac"), digits)
                           .alias(f"{value_col}_quantile"))
        out = part if out is None else out.unionByName(part)
    return out


def exact_quantiles_ranked(df: DataFrame, value_col: str, groups, qs: list[float], digits: int = 6,
                           interpolate: bool = True) -> DataFrame:
    """Exact quantiles for ANY value distribution (no bound on distinct values).

    Rows are numbered in (groups, value) order by the distributed global
    index (range partitioning: a group with a third of all rows is spread
    over many partitions, never sorted in one task); each group's first
    index and size come from one partial aggregate (one row per group); the
    rows at the target ranks are picked by a filter.  Same definitions as
    :func:`exact_quantiles` (linear, or discrete with ``interpolate=False``).
    """
    from seedlabel.operators.splits import global_index
    from seedlabel.session import broadcast_if_bounded
    g = list(groups)
    v = F.round(F.col(value_col), digits).alias("v")
    idx = global_index(df.select(*g, v), [*g, "v"], "_i")
    bounds = idx.groupBy(*g).agg(F.min("_i").alias("_start"), F.count(F.lit(1)).alias("n"))
    n_groups = bounds.count()
    ranked = idx.join(broadcast_if_bounded(bounds, n_groups), g).withColumn("_r", F.col("_i") - F.col("_start"))
    out = None
    for q in qs:
        if interpolate:
            h = (F.col("n") - 1) * F.lit(q)
            lo, hi = F.floor(h), F.ceil(h)
            pick = ranked.filter((F.col("_r") == lo) | (F.col("_r") == hi))
            part = pick.groupBy(*g).agg(
                F.max(F.when(F.col("_r") == lo, F.col("v"))).alias("lo_v"),
                F.max(F.when(F.col("_r") == hi, F.col("v"))).alias("hi_v"),
                F.first(h - lo).alias("frac"))
            val = F.round(F.col("lo_v") + (F.col("hi_v") - F.col("lo_v")) * F.col("frac"), digits)
        else:
            target = F.ceil(F.col("n") * F.lit(q)) - 1
            part = ranked.filter(F.col("_r") == target).groupBy(*g).agg(F.first("v").alias("x"))
            val = F.col("x")
        part = part.select(*g, F.lit(q).alias("q"), val.alias(f"{value_col}_quantile"))
        out = part if out is None else out.unionByName(part)
    return out
