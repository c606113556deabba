"""Evaluation: label counts, classification report, confusion matrix, shares,
run averages.

Every report starts with one partial aggregate ``groupBy(groups, actual,
pred).count()`` over the big table; what follows runs on that table, whose
size is bounded by groups x classes^2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_counts(df: DataFrame, cols=("aspect", "polarity"), with_totals: bool = False) -> DataFrame:
    """Count of labelled rows per label combination (optionally with rollup totals)."""
    g = df.rollup(*cols) if with_totals else df.groupBy(*cols)
    return g.agg(F.count(F.lit(1)).alias("n"))


def confusion_counts(df: DataFrame, actual: str, pred: str, groups=()) -> DataFrame:
    return (df.groupBy(*groups, F.col(actual).alias("actual"), F.col(pred).alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def _safe_div(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_report(df: DataFrame, actual: str, pred: str, groups=(), digits: int = 6) -> DataFrame:
    """Per-class precision/recall/F1/support plus ``accuracy``, ``macro avg``
    and ``weighted avg`` rows; 0 where a ratio's denominator is 0.

    The label set is the union of labels seen in ``actual`` and ``pred``.
    Output: ``(*groups, label string, precision, recall, f1, support)``;
    the ``accuracy`` row carries the accuracy in ``f1`` and NULL precision/recall.

    One linear chain, so the input is read once: confusion counts (partial
    aggregate) -> each count credited to its actual class (support), its
    predicted class (predictions) and, on the diagonal, true positives ->
    per-class sums -> group totals by a window over the (classes-sized)
    group -> the first class row of each group also emits the three summary
    rows.  No self-join, no union.
    """
    g = list(groups)
    cm = confusion_counts(df, actual, pred, g)
    roles = F.array(
        F.struct(F.col("actual").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("pred_n"),
                 F.when(F.col("actual") == F.col("pred"), F.col("n")).otherwise(0).cast("long").alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("pred_n"),
                 F.lit(0).cast("long").alias("tp")))
    per = (cm.select(*g, F.inline(roles)).groupBy(*g, "cls")
           .agg(*[F.sum(c).cast("long").alias(c) for c in ("support", "pred_n", "tp")]))
    prec = _safe_div(F.col("tp"), F.col("pred_n"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    f1 = _safe_div(2 * F.col("tp"), F.col("support") + F.col("pred_n"))
    per = per.select(*g, "cls", "support", "tp", prec.alias("p"), rec.alias("r"), f1.alias("f"))
    w = Window.partitionBy(*g) if g else Window.partitionBy()
    tot = {
        "total": F.sum("support").over(w), "tp_all": F.sum("tp").over(w),
        "mp": F.avg("p").over(w), "mr": F.avg("r").over(w), "mf": F.avg("f").over(w),
        "wp": F.sum(F.col("p") * F.col("support")).over(w), "wr": F.sum(F.col("r") * F.col("support")).over(w),
        "wf": F.sum(F.col("f") * F.col("support")).over(w),
        "first": F.row_number().over(w.orderBy("cls")) == 1,
    }
    per = per.select("*", *[v.alias(k) for k, v in tot.items()])
    r = lambda c: F.round(c, digits)
    null = F.lit(None).cast("double")
    row = lambda lab, p, rc, f, sup: F.struct(lab.alias("label"), p.alias("precision"), rc.alias("recall"),
                                              f.alias("f1"), sup.alias("support"))
    summary = [
        row(F.lit("accuracy"), null, null, r(_safe_div(F.col("tp_all"), F.col("total"))), F.col("total")),
        row(F.lit("macro avg"), r(F.col("mp")), r(F.col("mr")), r(F.col("mf")), F.col("total")),
        row(F.lit("weighted avg"), r(_safe_div(F.col("wp"), F.col("total"))), r(_safe_div(F.col("wr"), F.col("total"))),
            r(_safe_div(F.col("wf"), F.col("total"))), F.col("total")),
    ]
    own = row(F.col("cls").cast("string"), r(F.col("p")), r(F.col("r")), r(F.col("f")), F.col("support"))
    rows = F.when(F.col("first"), F.array(own, *summary)).otherwise(F.array(own))
    return per.select(*g, F.inline(rows))


def report_summary(report: DataFrame, groups=()) -> DataFrame:
    """One row per group: accuracy and the macro averages (what a run stores)."""
    g = list(groups)
    pick = lambda lab, c: F.max(F.when(F.col("label") == lab, F.col(c)))
    return report.groupBy(*g).agg(pick("accuracy", "f1").alias("accuracy"), pick("macro avg", "precision").alias("precision"),
                                  pick("macro avg", "recall").alias("recall"), pick("macro avg", "f1").alias("f1_score"))


def confusion_matrix(df: DataFrame, actual: str, pred: str, classes: list[int], groups=()) -> DataFrame:
    """Wide matrix: one row per (groups, actual), one ``pred_{c}`` count column per class."""
    cm = confusion_counts(df, actual, pred, groups)
    wide = cm.groupBy(*groups, "actual").pivot("pred", classes).agg(F.sum("n"))
    return wide.select(*groups, "actual", *[F.coalesce(F.col(str(c)), F.lit(0)).cast("long").alias(f"pred_{c}")
                                            for c in classes])


def share(df: DataFrame, col: str, digits: int = 6) -> DataFrame:
    """Count and percentage share per value of ``col``."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return c.select(col, "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), digits).alias("pct"))


def run_averages(summaries: DataFrame, groups=(), digits: int = 6) -> DataFrame:
    """Mean accuracy / precision / recall / F1 over runs."""
    return summaries.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("runs"),
        *[F.round(F.avg(c), digits).alias(f"avg_{c}") for c in ("accuracy", "precision", "recall", "f1_score")])
