"""Seed-sentence labelling on the ``embeddings`` table.

Domain set-up (fixed parameters of these queries): the aspect classes are the
``label`` values; the polarity classes split them in two (label < 5 -> 0,
else 1).  The seeds of a class are its 5 lowest ``vec_id`` rows; every other
row is scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedlabel.operators import metrics, thresholds
from seedlabel.operators.prototypes import score_with_prototypes, seed_prototype_sets
from seedlabel.session import load_table

# Fixed query parameters.
SEEDS_PER_CLASS = 5
ASPECT_THRESHOLD = 0.28
POLARITY_THRESHOLD = 0.19
RELAX = {0: 0.1}          # polarity class 0 gets both thresholds lowered by 0.1
GRID = [(0.24, 0.15), (0.28, 0.19), (0.32, 0.23)]
QUANTILES = [0.5, 0.9]
FOCAL_GAMMAS = [0.0, 2.0, 4.0]
GCE_Q = 0.4
N_ASPECTS = 10


def embedding_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (load_table(spark, sf_dir, "embeddings")
            .select("vec_id", "embedding", F.col("label").alias("gold_aspect"),
                    (F.col("label") >= 5).cast("int").alias("gold_polarity")))


def embedding_prototypes(emb: DataFrame):
    sets = seed_prototype_sets(emb, {"aspect": "gold_aspect", "polarity": "gold_polarity"}, "vec_id", "embedding",
                               SEEDS_PER_CLASS)
    return sets["aspect"][0], sets["polarity"][0]


def scored_embeddings(spark: SparkSession, sf_dir: str, keep_scores: bool = False) -> DataFrame:
    emb = embedding_input(spark, sf_dir)
    pa, pp = embedding_prototypes(emb)
    seed_ids = sorted({int(i) for p in (pa, pp) for i in p.proto_ids if i >= 0})
    targets = emb.filter(~F.col("vec_id").isin(seed_ids))
    out = score_with_prototypes(targets, "embedding", [pa, pp], keep_scores=keep_scores)
    cols = ["vec_id", "gold_aspect", "gold_polarity", "aspect", F.round("aspect_score", 6).alias("aspect_score"),
            "polarity", F.round("polarity_score", 6).alias("polarity_score")]
    if keep_scores:
        cols.append("aspect_scores")
    return out.select(*cols)


def q_seed_sentence_scores(spark, sf_dir):
    return scored_embeddings(spark, sf_dir)


def q_seed_sentence_labels(spark, sf_dir):
    s = scored_embeddings(spark, sf_dir)
    return thresholds.keep_confident(s, {"aspect_score": ASPECT_THRESHOLD, "polarity_score": POLARITY_THRESHOLD}) \
        .select("vec_id", "aspect", "aspect_score", "polarity", "polarity_score")


def q_label_counts(spark, sf_dir):
    return metrics.label_counts(q_seed_sentence_labels(spark, sf_dir), ("aspect", "polarity"))


def q_relaxed_threshold_labels(spark, sf_dir):
    s = scored_embeddings(spark, sf_dir)
    return thresholds.keep_confident_relaxed(
        s, {"aspect_score": ASPECT_THRESHOLD, "polarity_score": POLARITY_THRESHOLD}, "polarity", RELAX) \
        .select("vec_id", "aspect", "aspect_score", "polarity", "polarity_score")


def q_threshold_grid(spark, sf_dir):
    return thresholds.threshold_grid(scored_embeddings(spark, sf_dir), ("aspect_score", "polarity_score"), GRID)


def q_score_quantiles(spark, sf_dir):
    # discrete quantiles: an actual (6-place) score, so no half-way rounding ties
    return thresholds.exact_quantiles(scored_embeddings(spark, sf_dir), "aspect_score", ["aspect", "polarity"],
                                      QUANTILES, interpolate=False)


def _kinds_long(s: DataFrame) -> DataFrame:
    """Both kinds as long rows from ONE pass over the scored table."""
    return s.select(F.inline(F.array(
        F.struct(F.lit("aspect").alias("kind"), F.col("gold_aspect").alias("actual"), F.col("aspect").alias("pred")),
        F.struct(F.lit("polarity").alias("kind"), F.col("gold_polarity").alias("actual"),
                 F.col("polarity").alias("pred")))))


def q_classification_report(spark, sf_dir):
    return metrics.classification_report(_kinds_long(scored_embeddings(spark, sf_dir)), "actual", "pred", ["kind"])


def q_confusion_matrix(spark, sf_dir):
    s = scored_embeddings(spark, sf_dir)
    return metrics.confusion_matrix(s, "gold_aspect", "aspect", list(range(N_ASPECTS)))


# ---------------------------------------------------------------------------
# Oracle SQL (DuckDB).  The CTE below is the whole scoring slice.

def _seed_cte(kind: str, cls_col: str) -> str:
    return f"""
s_{kind} AS (SELECT {cls_col} AS cls, vec_id, v FROM (
    SELECT *, row_number() OVER (PARTITION BY {cls_col} ORDER BY vec_id) AS rn FROM e) WHERE rn <= {SEEDS_PER_CLASS}),
p_{kind} AS (SELECT cls, v FROM s_{kind} UNION ALL
    SELECT cls, list(m ORDER BY i) FROM (
        SELECT cls, i, avg(x) AS m FROM (
            SELECT cls, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s_{kind}) GROUP BY cls, i)
    GROUP BY cls),"""


def _best_cte(kind: str) -> str:
    return f"""
c_{kind} AS (SELECT t.vec_id, p.cls, max(list_cosine_similarity(t.v, p.v)) AS s
    FROM t, p_{kind} p GROUP BY t.vec_id, p.cls),
b_{kind} AS (SELECT vec_id, cls AS {kind}, s AS {kind}_score FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cls) AS rn FROM c_{kind}) WHERE rn = 1),"""


SCORED_CTE = f"""
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label AS gold_aspect,
             CAST(label >= 5 AS INTEGER) AS gold_polarity FROM embeddings),
{_seed_cte('aspect', 'gold_aspect')}
{_seed_cte('polarity', 'gold_polarity')}
t AS (SELECT * FROM e WHERE vec_id NOT IN (SELECT vec_id FROM s_aspect UNION SELECT vec_id FROM s_polarity)),
{_best_cte('aspect')}
{_best_cte('polarity')}
scored AS (SELECT t.vec_id, t.gold_aspect, t.gold_polarity, b_aspect.aspect,
                  round(b_aspect.aspect_score, 6) AS aspect_score, b_polarity.polarity,
                  round(b_polarity.polarity_score, 6) AS polarity_score
           FROM t JOIN b_aspect USING (vec_id) JOIN b_polarity USING (vec_id))"""


def _with(body: str) -> str:
    return f"WITH {SCORED_CTE}\n{body}"


LABELS_SQL = (f"SELECT vec_id, aspect, aspect_score, polarity, polarity_score FROM scored "
              f"WHERE aspect_score >= {ASPECT_THRESHOLD} AND polarity_score >= {POLARITY_THRESHOLD}")

REPORT_SQL = """
cm AS (SELECT kind, actual, pred, count(*) AS n FROM (
        SELECT 'aspect' AS kind, gold_aspect AS actual, aspect AS pred FROM scored
        UNION ALL SELECT 'polarity', gold_polarity, polarity FROM scored) GROUP BY ALL),
cls AS (SELECT kind, actual AS cls FROM cm UNION SELECT kind, pred FROM cm),
per AS (SELECT c.kind, c.cls,
        coalesce((SELECT sum(n) FROM cm WHERE cm.kind = c.kind AND cm.actual = c.cls), 0) AS support,
        coalesce((SELECT sum(n) FROM cm WHERE cm.kind = c.kind AND cm.pred = c.cls), 0) AS pred_n,
        coalesce((SELECT sum(n) FROM cm WHERE cm.kind = c.kind AND cm.pred = c.cls AND cm.actual = c.cls), 0) AS tp
        FROM cls c),
m AS (SELECT kind, cls, support, tp,
        CASE WHEN pred_n = 0 THEN 0.0 ELSE tp / pred_n END AS precision,
        CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
        CASE WHEN support + pred_n = 0 THEN 0.0 ELSE 2 * tp / (support + pred_n) END AS f1 FROM per)
SELECT kind, CAST(cls AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM m
UNION ALL SELECT kind, 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m GROUP BY kind
UNION ALL SELECT kind, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM m GROUP BY kind
UNION ALL SELECT kind, 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM m GROUP BY kind"""


def _grid_sql() -> str:
    vals = ", ".join(f"({a}, {b})" for a, b in GRID)
    return _with(f""",
g(t1, t2) AS (VALUES {vals})
SELECT CAST(g.t1 AS DOUBLE) AS aspect_score_threshold, CAST(g.t2 AS DOUBLE) AS polarity_score_threshold,
       s.aspect, s.polarity, count(*) AS n
FROM scored s JOIN g ON s.aspect_score >= g.t1 AND s.polarity_score >= g.t2
GROUP BY ALL""")


def _quantile_sql() -> str:
    parts = [f"SELECT aspect, polarity, CAST({q} AS DOUBLE) AS q, quantile_disc(aspect_score, {q}) "
             f"AS aspect_score_quantile FROM scored GROUP BY aspect, polarity" for q in QUANTILES]
    return _with("\n" + "\nUNION ALL ".join(parts))


def _confusion_sql() -> str:
    cols = ", ".join(f"CAST(count(*) FILTER (WHERE aspect = {c}) AS BIGINT) AS pred_{c}" for c in range(N_ASPECTS))
    return _with(f"\nSELECT gold_aspect AS actual, {cols} FROM scored GROUP BY gold_aspect")


QUERIES = {
    "seed_sentence_scores": q_seed_sentence_scores,
    "seed_sentence_labels": q_seed_sentence_labels,
    "label_counts": q_label_counts,
    "relaxed_threshold_labels": q_relaxed_threshold_labels,
    "threshold_grid": q_threshold_grid,
    "score_quantiles": q_score_quantiles,
    "classification_report": q_classification_report,
    "confusion_matrix": q_confusion_matrix,
}

ORACLE = {
    "seed_sentence_scores": _with("\nSELECT * FROM scored"),
    "seed_sentence_labels": _with("\n" + LABELS_SQL),
    "label_counts": _with(f",\nl AS ({LABELS_SQL})\nSELECT aspect, polarity, count(*) AS n FROM l GROUP BY ALL"),
    "relaxed_threshold_labels": _with(f"""
SELECT vec_id, aspect, aspect_score, polarity, polarity_score FROM scored
WHERE aspect_score >= {ASPECT_THRESHOLD} - CASE WHEN polarity = 0 THEN {RELAX[0]} ELSE 0.0 END
  AND polarity_score >= {POLARITY_THRESHOLD} - CASE WHEN polarity = 0 THEN {RELAX[0]} ELSE 0.0 END"""),
    "threshold_grid": _grid_sql(),
    "score_quantiles": _quantile_sql(),
    "classification_report": _with("," + REPORT_SQL),
    "confusion_matrix": _confusion_sql(),
}


# ---------------------------------------------------------------------------
# Losses over the class scores (used as logits) and run averages.

from seedlabel.operators import losses as L  # noqa: E402

RUNS = 5


def _class_weights(spark, sf_dir):
    counts = metrics.label_counts(q_seed_sentence_labels(spark, sf_dir), ["aspect"]).withColumnRenamed("aspect", "cls")
    return L.class_weights(counts)


def q_class_weights(spark, sf_dir):
    return _class_weights(spark, sf_dir).withColumn("weight", F.round("weight", 6))


def q_focal_loss(spark, sf_dir):
    s = scored_embeddings(spark, sf_dir, keep_scores=True)
    return L.focal_loss(s, "aspect_scores", "gold_aspect", FOCAL_GAMMAS)


def q_gce_loss(spark, sf_dir):
    s = scored_embeddings(spark, sf_dir, keep_scores=True)
    w = _class_weights(spark, sf_dir)
    # class -> weight map: a class without weak labels weighs 0
    wmap = w.select(F.map_from_entries(F.collect_list(F.struct("cls", "weight"))).alias("w")).scalar()
    return L.gce_loss(s, "aspect_scores", "gold_aspect", GCE_Q, wmap)


def q_run_averages(spark, sf_dir):
    """RUNS seed draws (run r uses the (5r+1)..(5r+5)-th lowest ids of each
    class), each scored on the rows that are seeds in no run; macro metrics
    per run, averaged over runs."""
    emb = embedding_input(spark, sf_dir)
    cols = {"aspect": "gold_aspect", "polarity": "gold_polarity"}
    sets = seed_prototype_sets(emb, cols, "vec_id", "embedding", SEEDS_PER_CLASS, RUNS)
    kinds = [(kind, col, r, sets[kind][r]) for kind, col in cols.items() for r in range(RUNS)]
    seed_ids = {int(i) for _, _, _, ps in kinds for i in ps.proto_ids if i >= 0}
    targets = emb.filter(~F.col("vec_id").isin(sorted(seed_ids)))
    scored = score_with_prototypes(targets, "embedding", [k[3] for k in kinds])
    long = scored.select(F.inline(F.array(*[
        F.struct(F.lit(r).alias("run"), F.lit(kind).alias("kind"), F.col(col).alias("actual"),
                 F.col(ps.name).alias("pred")) for kind, col, r, ps in kinds])))
    rep = metrics.classification_report(long, "actual", "pred", ["run", "kind"])
    return metrics.run_averages(metrics.report_summary(rep, ["run", "kind"]), ["kind"])


LOSS_CTE = """,
lg AS (SELECT c.vec_id, c.cls, c.s, t.gold_aspect AS y FROM c_aspect c JOIN t USING (vec_id)),
ls AS (SELECT vec_id, max(s) AS m FROM lg GROUP BY vec_id),
lse AS (SELECT lg.vec_id, ln(sum(exp(lg.s - ls.m))) + ls.m AS lse FROM lg JOIN ls USING (vec_id) GROUP BY lg.vec_id, ls.m),
lp AS (SELECT lg.vec_id, lg.y, lg.s - lse.lse AS logp FROM lg JOIN lse USING (vec_id) WHERE lg.cls = lg.y),
lc AS (SELECT aspect AS cls, count(*) AS n FROM (""" + LABELS_SQL + """) GROUP BY aspect),
cw AS (SELECT CAST(cls AS INTEGER) AS cls, n, (1.0 / n) / sum(1.0 / n) OVER () AS weight FROM lc)"""


def _run_avg_sql() -> str:
    ctes = [f"""
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label AS gold_aspect,
             CAST(label >= 5 AS INTEGER) AS gold_polarity FROM embeddings)"""]
    for kind, col in (("aspect", "gold_aspect"), ("polarity", "gold_polarity")):
        ctes.append(f"""
rk_{kind} AS (SELECT {col} AS cls, vec_id, v, CAST((row_number() OVER (PARTITION BY {col} ORDER BY vec_id) - 1)
              // {SEEDS_PER_CLASS} AS INTEGER) AS run FROM e QUALIFY row_number() OVER (PARTITION BY {col} ORDER BY vec_id)
              <= {SEEDS_PER_CLASS * RUNS}),
pr_{kind} AS (SELECT run, cls, v FROM rk_{kind} UNION ALL
    SELECT run, cls, list(m ORDER BY i) FROM (
        SELECT run, cls, i, avg(x) AS m FROM (
            SELECT run, cls, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM rk_{kind}) GROUP BY run, cls, i)
    GROUP BY run, cls)""")
    ctes.append("""
t AS (SELECT * FROM e WHERE vec_id NOT IN (SELECT vec_id FROM rk_aspect UNION SELECT vec_id FROM rk_polarity))""")
    for kind, col in (("aspect", "gold_aspect"), ("polarity", "gold_polarity")):
        ctes.append(f"""
c_{kind} AS (SELECT t.vec_id, p.run, p.cls, max(list_cosine_similarity(t.v, p.v)) AS s, any_value(t.{col}) AS actual
             FROM t, pr_{kind} p GROUP BY t.vec_id, p.run, p.cls),
b_{kind} AS (SELECT run, '{kind}' AS kind, actual, cls AS pred FROM c_{kind}
             QUALIFY row_number() OVER (PARTITION BY vec_id, run ORDER BY s DESC, cls) = 1)""")
    ctes.append("""
lo AS (SELECT * FROM b_aspect UNION ALL SELECT * FROM b_polarity),
cm AS (SELECT run, kind, actual, pred, count(*) AS n FROM lo GROUP BY ALL),
cls AS (SELECT run, kind, actual AS cls FROM cm UNION SELECT run, kind, pred FROM cm),
per AS (SELECT c.run, c.kind, c.cls,
        coalesce((SELECT sum(n) FROM cm WHERE cm.run = c.run AND cm.kind = c.kind AND cm.actual = c.cls), 0) AS support,
        coalesce((SELECT sum(n) FROM cm WHERE cm.run = c.run AND cm.kind = c.kind AND cm.pred = c.cls), 0) AS pred_n,
        coalesce((SELECT sum(n) FROM cm WHERE cm.run = c.run AND cm.kind = c.kind AND cm.pred = c.cls
                  AND cm.actual = c.cls), 0) AS tp FROM cls c),
m AS (SELECT run, kind, cls, support, tp,
        CASE WHEN pred_n = 0 THEN 0.0 ELSE tp / pred_n END AS precision,
        CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
        CASE WHEN support + pred_n = 0 THEN 0.0 ELSE 2 * tp / (support + pred_n) END AS f1 FROM per),
sm AS (SELECT run, kind, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision,
              round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1_score FROM m GROUP BY run, kind)""")
    return "WITH " + ",".join(ctes) + """
SELECT kind, count(*) AS runs, round(avg(accuracy), 6) AS avg_accuracy, round(avg(precision), 6) AS avg_precision,
       round(avg(recall), 6) AS avg_recall, round(avg(f1_score), 6) AS avg_f1_score FROM sm GROUP BY kind"""


QUERIES.update({
    "class_weights": q_class_weights,
    "focal_loss": q_focal_loss,
    "gce_loss": q_gce_loss,
    "run_averages": q_run_averages,
})

ORACLE.update({
    "class_weights": _with(LOSS_CTE + "\nSELECT cls, n, round(weight, 6) AS weight FROM cw"),
    "focal_loss": _with(LOSS_CTE + "\n" + "\nUNION ALL ".join(
        f"SELECT CAST({g} AS DOUBLE) AS gamma, round(avg(-pow(1 - exp(logp), {g}) * logp), 6) AS loss FROM lp"
        for g in FOCAL_GAMMAS)),
    "gce_loss": _with(LOSS_CTE + f"""
SELECT CAST({GCE_Q} AS DOUBLE) AS q, round(pow(avg((1 - pow(exp(lp.logp), {GCE_Q})) / {GCE_Q} * coalesce(cw.weight, 0)), 2), 6) AS loss
FROM lp LEFT JOIN cw ON cw.cls = lp.y"""),
    "run_averages": _run_avg_sql(),
})


def scored_embeddings_with_vectors(spark, sf_dir):
    """Scored non-seed rows, keeping the embedding for downstream training."""
    emb = embedding_input(spark, sf_dir)
    pa, pp = embedding_prototypes(emb)
    seed_ids = sorted({int(i) for p in (pa, pp) for i in p.proto_ids if i >= 0})
    return score_with_prototypes(emb.filter(~F.col("vec_id").isin(seed_ids)), "embedding", [pa, pp])


def weak_labelled(spark, sf_dir):
    """Confident rows with their vectors: the weakly labelled training set."""
    s = scored_embeddings_with_vectors(spark, sf_dir)
    return s.filter((F.round("aspect_score", 6) >= ASPECT_THRESHOLD) & (F.round("polarity_score", 6) >= POLARITY_THRESHOLD))
