import numpy as np
import pytest
from pyspark.sql import functions as F

from seedlabel.operators import thresholds
from seedlabel.operators.prototypes import collect_prototypes, prototypes, score_with_prototypes


def test_cosine_and_mean_prototype(spark):
    seeds = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.0, 2.0])], "cls int, id long, v array<double>")
    protos = prototypes(seeds, "cls", "v", "id")
    ps = collect_prototypes("aspect", protos)
    mean = [r for r in protos.collect() if r.proto_id == -1][0].vec
    assert mean == [0.5, 1.0]
    df = spark.createDataFrame([(7, [1.0, 1.0])], "id long, v array<double>")
    out = score_with_prototypes(df, "v", [ps], keep_scores=True).first()
    assert out.aspect == 0
    assert round(out.aspect_score, 6) == 0.948683
    # individual seed cosines are 0.707107 each: the mean prototype wins
    m = ps.matrix / np.linalg.norm(ps.matrix, axis=1, keepdims=True)
    cos = m @ (np.array([1.0, 1.0]) / np.sqrt(2))
    assert sorted(np.round(cos, 6).tolist()) == [0.707107, 0.707107, 0.948683]


def test_argmax_tie_takes_lower_class(spark):
    seeds = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0])], "cls int, id long, v array<double>")
    ps = collect_prototypes("k", prototypes(seeds, "cls", "v", "id"))
    out = score_with_prototypes(spark.createDataFrame([(1, [1.0, 1.0])], "id long, v array<double>"), "v", [ps])
    assert out.first().k == 0


def test_prototype_chunks_merge_to_the_same_scores(spark):
    rng = np.random.default_rng(5)
    seeds = spark.createDataFrame([(i % 3, i, rng.normal(size=4).tolist()) for i in range(20)],
                                  "cls int, id long, v array<double>")
    ps = collect_prototypes("k", prototypes(seeds, "cls", "v", "id"))
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)] + [(99, None)],
                               "id long, v array<double>")
    whole = score_with_prototypes(df, "v", [ps], keep_scores=True).orderBy("id").collect()
    parts = score_with_prototypes(df, "v", [ps], keep_scores=True, max_cells=8).orderBy("id").collect()
    assert [(r.id, r.k) for r in whole] == [(r.id, r.k) for r in parts]
    assert whole[-1].k is whole[-1].k_score is parts[-1].k is parts[-1].k_score is None
    assert np.allclose([r.k_scores for r in whole[:-1]], [r.k_scores for r in parts[:-1]])


@pytest.mark.parametrize("vec", [[1.0, 2.0, 3.0], [1.0]])
def test_wrong_vector_length_raises(spark, vec):
    seeds = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0])], "cls int, id long, v array<double>")
    ps = collect_prototypes("k", prototypes(seeds, "cls", "v", "id"))
    df = spark.createDataFrame([(1, [1.0, 1.0]), (2, vec)], "id long, v array<double>")
    with pytest.raises(Exception, match="dimensions"):
        score_with_prototypes(df, "v", [ps]).collect()


def test_threshold_relaxation(spark):
    df = spark.createDataFrame([(1, 0.65, 0, 0.45), (2, 0.65, 1, 0.45)],
                               "id int, aspect_score double, polarity int, polarity_score double")
    kept = thresholds.keep_confident_relaxed(df, {"aspect_score": 0.7, "polarity_score": 0.5}, "polarity", {0: 0.1})
    assert [r.id for r in kept.collect()] == [1]


def test_threshold_grid_and_monotone(spark):
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(0, 3)), int(rng.integers(0, 2)), float(rng.random()), float(rng.random()))
            for _ in range(200)]
    df = spark.createDataFrame(rows, "aspect int, polarity int, a double, p double")
    grid = [(0.2, 0.2), (0.5, 0.5), (0.8, 0.8)]
    out = thresholds.threshold_grid(df, ("a", "p"), grid).collect()
    for t1, t2 in grid:
        exp = sum(1 for r in rows if r[2] >= t1 and r[3] >= t2)
        assert sum(r.n for r in out if r.a_threshold == t1 and r.p_threshold == t2) == exp
    totals = [sum(r.n for r in out if r.a_threshold == t1) for t1, _ in grid]
    assert totals == sorted(totals, reverse=True)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = np.round(rng.random(101), 6)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(vals)], "g int, s double")
    out = {(r.g, r.q): r.s_quantile for r in thresholds.exact_quantiles(df, "s", ["g"], [0.5, 0.9]).collect()}
    for g in (0, 1):
        sub = vals[g::2]
        for q in (0.5, 0.9):
            assert out[(g, q)] == pytest.approx(round(float(np.quantile(sub, q)), 6), abs=1e-6)
    disc = {(r.g, r.q): r.s_quantile for r in thresholds.exact_quantiles(df, "s", ["g"], [0.5, 0.9],
                                                                          interpolate=False).collect()}
    for g in (0, 1):
        sub = np.sort(vals[g::2])
        for q in (0.5, 0.9):
            assert disc[(g, q)] == sub[int(np.ceil(q * len(sub))) - 1]


def test_ranked_quantiles_equal_histogram_and_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.normal(size=301) * 1000, 6)        # unbounded range
    rows = [(int(i % 3 == 0), float(v)) for i, v in enumerate(vals)]   # group 1 holds a third
    df = spark.createDataFrame(rows, "g int, s double")
    for interp in (True, False):
        a = {(r.g, r.q): r.s_quantile for r in thresholds.exact_quantiles(df, "s", ["g"], [0.1, 0.5, 0.9],
                                                                          interpolate=interp).collect()}
        b = {(r.g, r.q): r.s_quantile for r in thresholds.exact_quantiles_ranked(df, "s", ["g"], [0.1, 0.5, 0.9],
                                                                                 interpolate=interp).collect()}
        assert a.keys() == b.keys()
        for k in a:
            assert a[k] == pytest.approx(b[k], abs=1e-6)
    for g in (0, 1):
        sub = np.sort(np.array([v for gg, v in rows if gg == g]))
        assert b[(g, 0.5)] == sub[int(np.ceil(0.5 * len(sub))) - 1]
