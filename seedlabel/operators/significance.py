"""Pairwise model comparison: one-sided pooled two-sample t-tests between
every ordered pair of models, Bonferroni and Holm adjustment, p-value matrix.

The only pass over the big table is one partial aggregate per
(groups, model): n, mean, sample variance.  Pairs, statistics and
adjustments run on that (groups x models^2) table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedlabel.functions.stats import t_cdf_udf


def model_stats(df: DataFrame, groups, model_col: str, value_col: str) -> DataFrame:
    return df.groupBy(*groups, F.col(model_col).alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value_col).alias("mean"), F.var_samp(value_col).alias("var"))


def pair_tests(stats: DataFrame, groups) -> DataFrame:
    """Every ordered pair (a, b) incl. a = b within each group:
    t = (mean_a - mean_b) / sqrt(sp2 (1/n_a + 1/n_b)), df = n_a + n_b - 2,
    sp2 the pooled variance."""
    g = list(groups) or ["_all"]
    if not groups:
        stats = stats.withColumn("_all", F.lit(0))
    a = stats.select(*g, *[F.col(c).alias(f"{c}_a") for c in ("model", "n", "mean", "var")])
    b = stats.select(*g, *[F.col(c).alias(f"{c}_b") for c in ("model", "n", "mean", "var")])
    # equi-join on the group: the pairs are those of the (few) models of a group,
    # on the aggregated statistics table, never on data rows
    p = a.join(b, g)
    dof = F.col("n_a") + F.col("n_b") - 2
    sp2 = F.try_divide((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"), dof)
    se = F.sqrt(sp2 * (F.lit(1.0) / F.col("n_a") + F.lit(1.0) / F.col("n_b")))
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), se)
    out = p.select(*g, F.col("model_a"), F.col("model_b"), "n_a", "n_b", t.alias("t"), dof.cast("long").alias("df"))
    return out if groups else out.drop("_all")


def adjust(tests: DataFrame, groups, n_models: int | None = None) -> DataFrame:
    """p (alternative 'less'), Bonferroni min(p * K, 1) with K = unordered pairs,
    and Holm step-down over the off-diagonal pairs of each group (NULL on the
    diagonal)."""
    g = list(groups)
    p = tests.withColumn("p", t_cdf_udf(F.col("t"), F.col("df").cast("double")))
    if n_models is None:
        k = F.size(F.collect_set("model_a").over(Window.partitionBy(*g)))
    else:
        k = F.lit(n_models)
    p = p.withColumn("_k", k)
    p = p.withColumn("p_bonferroni", F.least(F.col("p") * (F.col("_k") * (F.col("_k") - 1) / 2), F.lit(1.0)))
    off = F.col("model_a") != F.col("model_b")
    w = Window.partitionBy(*g, off.alias("_off")).orderBy("p", "model_a", "model_b")
    m = F.count(F.lit(1)).over(Window.partitionBy(*g, off.alias("_off")))
    raw = (m - F.row_number().over(w) + 1) * F.col("p")
    p = p.withColumn("_raw", raw)
    run = F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    p = p.withColumn("p_holm", F.when(off, F.least(run, F.lit(1.0))))
    return p.drop("_k", "_raw")


def pvalue_matrix(adjusted: DataFrame, groups, models: list[str], value: str = "p_holm") -> DataFrame:
    """Wide matrix: one row per (groups, model_a), one column per model_b,
    diagonal 1."""
    v = F.when(F.col("model_a") == F.col("model_b"), F.lit(1.0)).otherwise(F.col(value))
    wide = adjusted.withColumn("_v", v).groupBy(*groups, "model_a").pivot("model_b", models).agg(F.first("_v"))
    return wide
