import math

import pytest
from pyspark.sql import functions as F

from seedlabel.functions.stats import t_cdf
from seedlabel.operators import losses as L
from seedlabel.operators import metrics
from seedlabel.operators import significance as S
from seedlabel.operators.classifier import sum_and_threshold


def _report(spark, gold, pred):
    df = spark.createDataFrame(list(zip(gold, pred)), "a int, p int")
    return {r.label: r for r in metrics.classification_report(df, "a", "p").collect()}


def test_classification_report_fixture(spark):
    r = _report(spark, [0, 0, 1, 1, 2, 2], [0, 1, 1, 1, 2, 0])
    assert (r["0"].precision, r["0"].recall, r["0"].f1) == (0.5, 0.5, 0.5)
    assert (r["1"].precision, r["1"].recall, r["1"].f1) == (0.666667, 1.0, 0.8)
    assert (r["2"].precision, r["2"].recall, r["2"].f1) == (1.0, 0.5, 0.666667)
    assert r["0"].support == 2 and r["accuracy"].f1 == 0.666667 and r["accuracy"].support == 6
    assert (r["macro avg"].precision, r["macro avg"].recall, r["macro avg"].f1) == (0.722222, 0.666667, 0.655556)


def test_zero_division(spark):
    r = _report(spark, [0, 1], [0, 0])
    assert r["1"].precision == 0.0 and r["1"].f1 == 0.0


def test_confusion_matrix(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "a int, p int")
    m = {r.actual: (r.pred_0, r.pred_1, r.pred_2) for r in metrics.confusion_matrix(df, "a", "p", [0, 1, 2]).collect()}
    assert m == {0: (1, 1, 0), 1: (0, 1, 0)}


def test_class_weights(spark):
    c = spark.createDataFrame([(0, 345), (1, 67), (2, 201)], "cls int, n long")
    w = {r.cls: r.weight for r in L.class_weights(c).collect()}
    assert [round(w[i], 6) for i in range(3)] == [0.127135, 0.654649, 0.218216]


def test_focal_and_gce(spark):
    df = spark.createDataFrame([([math.log(0.8), math.log(0.2)], 0)], "lg array<double>, y int")
    f = {r.gamma: r.loss for r in L.focal_loss(df, "lg", "y", [0.0, 2.0, 4.0], digits=8).collect()}
    assert f == {0.0: 0.22314355, 2.0: 0.00892574, 4.0: 0.00035703}
    g = L.gce_loss(df, "lg", "y", 0.4, F.array(F.lit(1.0), F.lit(1.0)), digits=12).first().loss
    assert math.sqrt(g) == pytest.approx(0.21347474, abs=1e-8)


def test_t_test_fixture(spark):
    a = [.81, .83, .79, .80, .82]
    b = [.84, .85, .83, .86, .82]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "m string, v double")
    t = S.pair_tests(S.model_stats(df, [], "m", "v"), [])
    r = {(x.model_a, x.model_b): x for x in S.adjust(t, []).collect()}
    assert r[("a", "b")].t == pytest.approx(-3.0, abs=1e-9) and r[("a", "b")].df == 8
    assert round(r[("a", "b")].p, 6) == 0.008536
    assert r[("a", "a")].p_holm is None
    assert t_cdf(0.0, 8) == pytest.approx(0.5)


def test_holm_and_bonferroni(spark):
    # four off-diagonal pairs with given p-values: feed t-values that give them
    import itertools
    from seedlabel.operators.significance import adjust
    ps = [0.01, 0.04, 0.03, 0.005]
    # invert the t cdf numerically
    def t_for(p, df=30):
        lo, hi = -50.0, 50.0
        for _ in range(200):
            mid = (lo + hi) / 2
            (lo, hi) = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
        return lo
    rows = [(f"m{i}", f"x{i}", t_for(p), 30) for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "model_a string, model_b string, t double, df long")
    out = {r.model_a: r for r in adjust(df, [], n_models=2).collect()}
    assert [round(out[f"m{i}"].p_holm, 6) for i in range(4)] == [0.03, 0.06, 0.06, 0.02]
    assert round(out["m0"].p_bonferroni, 6) == 0.01   # K = 2*(2-1)/2 = 1
    _ = itertools


def test_document_aspects_sum(spark):
    df = spark.createDataFrame([(1, [1.5, 0.0]), (1, [1.0, 0.5])], "doc int, lg array<double>")
    out = [(r.doc, r.label, r.logit_sum) for r in sum_and_threshold(df, "doc", "lg", 2.0).collect()]
    assert out == [(1, 0, 2.5)]


def test_bonferroni_28_fixture(spark):
    from seedlabel.operators.significance import adjust

    def t_for(p, df=30):
        lo, hi = -50.0, 50.0
        for _ in range(200):
            mid = (lo + hi) / 2
            (lo, hi) = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
        return lo

    rows = [("a", "b", t_for(0.01), 30), ("b", "a", t_for(0.5), 30)]
    out = {r.model_a: r for r in adjust(spark.createDataFrame(rows, "model_a string, model_b string, t double, df long"),
                                        [], n_models=8).collect()}
    assert round(out["a"].p_bonferroni, 6) == 0.28      # 8 models -> 28 unordered pairs
    assert out["b"].p_bonferroni == 1.0
