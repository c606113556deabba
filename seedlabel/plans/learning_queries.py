"""Classifiers on weak labels: word-vector cosine, softmax heads on
embeddings (focal / GCE), keyword-trained text classifiers, ablation table,
hyper-parameter trials.  The SQL twins of the trained ones spell out every
gradient step; the dense vectors have none."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from seedlabel.functions.text import tokens
from seedlabel.operators import classifier as C
from seedlabel.operators import countvec as CV
from seedlabel.operators import densevec as DV
from seedlabel.operators import metrics
from seedlabel.operators.keywords import encode_labels, keyword_labels
from seedlabel.operators.packed import pack
from seedlabel.operators.splits import hash_uniform
from seedlabel.plans import embedding_queries as EQ
from seedlabel.plans import text_queries as TQ
from seedlabel.session import ROW_BY_ROW, broadcast_if_bounded, emptied, settings, shared_path, written_table

# Fixed query parameters.
GAMMA_ASPECT = 3.0
GAMMA_POLARITY = 3.0
GCE_Q = 0.4
GD = dict(step=0.5, iters=25, reg=1e-4)
GD_MOMENTUM = 0.9
SEARCH_SPACE = {"gamma": [0.0, 2.0, 4.0], "reg": [1e-4, 1e-2], "step": [0.1, 0.5]}
SEARCH_TRIALS = 4
SEARCH_SEED = 7
TRAIN_FRACTION = 0.8


def _sentences(spark, sf_dir):
    s = TQ.sentences(spark, sf_dir).withColumn("tokens", tokens("sentence"))
    return s.select("doc_id", "pos", encode_labels("lang", TQ.LANGS).alias("gold"), "tokens")


def _seed_texts(spark):
    rows = [(c, p, w) for c, seeds in enumerate(TQ.LANG_SEEDS) for p, w in enumerate(seeds)]
    return spark.createDataFrame(rows, "cls int, seed_pos int, text string")


def _word_model(spark, sf_dir, per_seed: bool = False):
    """Sentences, word scores and prototype keys of the count-based vectors."""
    sent = pack(_sentences(spark, sf_dir), ["doc_id", "pos", "gold"])  # read by the counts and by the labelling
    margin = written_table(CV.margins(sent), "word-margins")
    pairs = CV.context_pair_counts(sent, CV.top_contexts(margin))
    vecs = written_table(CV.vectors(pairs, margin=margin), "word-vectors")
    keys = [(c, p if per_seed else -1) for c, seeds in enumerate(TQ.LANG_SEEDS)
            for p in (range(len(seeds)) if per_seed else (0,))]
    scores = CV.word_scores(vecs, CV.seed_prototypes(vecs, _seed_texts(spark), per_seed), len(keys))
    return sent, scores, keys


def _word_labels(spark, sf_dir, per_seed: bool = False):
    sent, scores, keys = _word_model(spark, sf_dir, per_seed)
    return CV.classify(sent, scores, keys, len(TQ.LANG_SEEDS), ["doc_id", "pos"], ["gold"])


def q_word_vector_labels(spark, sf_dir):
    out = _word_labels(spark, sf_dir)
    return out.select("doc_id", "pos", "label", F.round("score", 6).alias("score"), "gold")


def q_class_neighbours(spark, sf_dir):
    """The 10 vocabulary words closest to each class prototype (mean of the
    class's seed word vectors)."""
    _, scores, _ = _word_model(spark, sf_dir)
    return CV.similar_words(scores, list(range(len(TQ.LANG_SEEDS))), 10)


def q_word_vector_report(spark, sf_dir):
    return metrics.classification_report(_word_labels(spark, sf_dir), "gold", "label")


def q_word_vector_seed_report(spark, sf_dir):
    """One prototype per seed text; a sentence takes the class of its most
    similar seed."""
    return metrics.classification_report(_word_labels(spark, sf_dir, per_seed=True), "gold", "label")


def q_trained_vector_report(spark, sf_dir):
    """The same classifier with dense vectors: 100 numbers a word from a
    factorisation of the PPMI table (iterative, so without a SQL twin)."""
    sent = pack(_sentences(spark, sf_dir), ["doc_id", "pos", "gold"])  # read by the counts and by the labelling
    place = shared_path(spark, "word-vectors")
    vecs = DV.dense_vectors(sent, place=place)
    with settings(spark, ROW_BY_ROW):
        scores = written_table(DV.word_scores(vecs, _seed_texts(spark)), "word-scores")
    emptied(spark, place)
    scores = broadcast_if_bounded(scores, scores.count(), row_bytes=256)
    labels = CV.classify(sent, scores, [(c, -1) for c in range(len(TQ.LANG_SEEDS))], len(TQ.LANG_SEEDS),
                         ["doc_id", "pos"], ["gold"])
    return metrics.classification_report(labels, "gold", "label")


def _train_heads(weak, gamma_a, gamma_p, q=None, weights=None):
    wa, wp = (weights or (None, None))
    ha = C.train_softmax_head(weak, "embedding", "aspect", EQ.N_ASPECTS, gamma=gamma_a, q=q, class_weights=wa, **GD)
    hp = C.train_softmax_head(weak, "embedding", "polarity", 2, gamma=gamma_p, q=q, class_weights=wp, **GD)
    return {"pred_aspect": ha, "pred_polarity": hp}


def _heads_report(spark, sf_dir, heads):
    pred = C.predict_heads(EQ.scored_embeddings_with_vectors(spark, sf_dir), "embedding", heads)
    long = pred.select(F.inline(F.array(
        F.struct(F.lit("aspect").alias("kind"), F.col("gold_aspect").alias("actual"), F.col("pred_aspect").alias("pred")),
        F.struct(F.lit("polarity").alias("kind"), F.col("gold_polarity").alias("actual"),
                 F.col("pred_polarity").alias("pred")))))
    return metrics.classification_report(long, "actual", "pred", ["kind"])


def q_joint_classifier(spark, sf_dir):
    weak = EQ.weak_labelled(spark, sf_dir)
    return _heads_report(spark, sf_dir, _train_heads(weak, GAMMA_ASPECT, GAMMA_POLARITY))


def q_ablation_results(spark, sf_dir):
    """Summary rows (accuracy, macro P/R/F1) per variant and kind:
    ``none`` (focal heads), ``without_focal_loss`` (GCE heads, unweighted: alpha
    is 1 there), ``without_deep_learning`` (the labeler's own predictions)."""
    weak = EQ.weak_labelled(spark, sf_dir)
    reports = []
    r = _heads_report(spark, sf_dir, _train_heads(weak, GAMMA_ASPECT, GAMMA_POLARITY))
    reports.append(metrics.report_summary(r, ["kind"]).withColumn("variant", F.lit("none")))
    r = _heads_report(spark, sf_dir, _train_heads(weak, 0.0, 0.0, q=GCE_Q))
    reports.append(metrics.report_summary(r, ["kind"]).withColumn("variant", F.lit("without_focal_loss")))
    r = EQ.q_classification_report(spark, sf_dir)
    reports.append(metrics.report_summary(r, ["kind"]).withColumn("variant", F.lit("without_deep_learning")))
    out = reports[0]
    for x in reports[1:]:
        out = out.unionByName(x)
    return out.select("variant", "kind", "accuracy", "precision", "recall", "f1_score")


def q_keyword_classifier(spark, sf_dir):
    """Text classifier trained on keyword-labelled lines, evaluated on every
    line (those without tokens too) against the document language."""
    lines = keyword_labels(TQ.keyword_lines(spark, sf_dir), "tokens", TQ.LANG_SEEDS, keep_all=True)
    # tokenised and hashed once, read by the fit and by the prediction
    lines = written_table(C.hashed_texts(lines, "tokens").select("gold", "label", "tf"), "hashed-lines")
    model = C.keyword_text_classifier(lines.filter("label is not null"), "tokens", "label")
    pred = model.stages[-1].transform(lines)
    return metrics.classification_report(pred.withColumn("pred", F.col("prediction").cast("int")), "gold", "pred")


def q_hyper_search(spark, sf_dir, trials_path: str | None = None):
    """Seeded sample of the parameter grid; each trial trains the aspect head
    on the hash-chosen 80 % of the weak labels and reports validation loss
    and accuracy on the rest.  One row per trial, best first.  With
    ``trials_path`` the search resumes: trials already in that table are
    skipped and new ones are appended to it."""
    weak = EQ.weak_labelled(spark, sf_dir).withColumn("u", hash_uniform("vec_id"))
    weak = weak.select("vec_id", "embedding", "aspect", "u").checkpoint(eager=True)  # scored once, read by every trial
    train, val = weak.filter(F.col("u") < TRAIN_FRACTION), weak.filter(F.col("u") >= TRAIN_FRACTION)
    grid = [(g, r, s) for g in SEARCH_SPACE["gamma"] for r in SEARCH_SPACE["reg"] for s in SEARCH_SPACE["step"]]
    rnd = random.Random(SEARCH_SEED)
    trials = rnd.sample(grid, min(SEARCH_TRIALS, len(grid)))
    done = set()
    if trials_path:
        from seedlabel.sources.writers import pending_trials
        cand = spark.createDataFrame([(float(g), float(r), float(s)) for g, r, s in trials],
                                     "gamma double, reg double, step double")
        todo = {(x.gamma, x.reg, x.step) for x in pending_trials(spark, cand, trials_path,
                                                                  ["gamma", "reg", "step"]).collect()}
        done = {t for t in ((float(g), float(r), float(s)) for g, r, s in trials) if t not in todo}
    rows = []
    for i, (g, r, s) in enumerate(trials):
        if (float(g), float(r), float(s)) in done:
            continue
        head = C.train_softmax_head(train, "embedding", "aspect", EQ.N_ASPECTS, gamma=g, reg=r, step=s,
                                    iters=GD["iters"])
        loss, acc = C.evaluate_head(val, head, "embedding", "aspect", gamma=g)
        rows.append((i, float(g), float(r), float(s), round(float(loss), 6), round(float(acc), 6)))
    df = spark.createDataFrame(rows, "trial int, gamma double, reg double, step double, val_loss double, "
                                     "val_accuracy double")
    if trials_path:
        from seedlabel.sources.writers import append_trials
        if rows:
            append_trials(df, trials_path)
        df = spark.read.parquet(trials_path)
    return df.orderBy("val_loss", "trial")


QUERIES = {
    "word_vector_labels": q_word_vector_labels,
    "word_vector_report": q_word_vector_report,
    "word_vector_seed_report": q_word_vector_seed_report,
    "class_neighbours": q_class_neighbours,
    "trained_vector_report": q_trained_vector_report,
    "joint_classifier": q_joint_classifier,
    "ablation_results": q_ablation_results,
    "keyword_classifier": q_keyword_classifier,
    "hyper_search": q_hyper_search,
}
ORACLE: dict[str, str] = {}


_SEED_ROWS = ", ".join(f"({c}, {p}, '{w}')" for c, seeds in enumerate(TQ.LANG_SEEDS) for p, w in enumerate(seeds))


def _word_vector_cte(per_seed: bool = False) -> str:
    proto = "seed_pos" if per_seed else "-1"
    return "WITH " + TQ.SENTENCES_CTE + f""",
st AS (SELECT doc_id, pos, lang, list_filter(regexp_split_to_array(sentence, '\\s+'), lambda x: x <> '') AS t FROM sents),
tk AS (SELECT doc_id, pos, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM st),
pr AS (SELECT a.word AS a, b.word AS b FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND a.pos = b.pos AND b.i = a.i + 1
       UNION ALL
       SELECT a.word, b.word FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND a.pos = b.pos AND b.i = a.i + 2),
pc AS (SELECT word, context, count(*) AS n FROM (
        SELECT a AS word, b AS context FROM pr UNION ALL SELECT b, a FROM pr) GROUP BY ALL),
mg AS (SELECT word, sum(n) AS m FROM pc GROUP BY word),
cx AS (SELECT word AS context, m AS mc FROM mg ORDER BY m DESC, word LIMIT {CV.DIMS}),
vc AS (SELECT word, context, x FROM (
        SELECT pc.word, pc.context, ln(CAST(n AS DOUBLE) * (SELECT sum(m) FROM mg) / (CAST(m AS DOUBLE) * CAST(mc AS DOUBLE))) AS x
        FROM pc JOIN cx USING (context) JOIN mg USING (word) WHERE m >= {CV.MIN_PAIRS}) WHERE x > 0),
sd(cls, seed_pos, word) AS (VALUES {_SEED_ROWS}),
ps AS (SELECT cls, {proto} AS proto, context, sum(x) AS x FROM vc JOIN sd USING (word) GROUP BY ALL),
pn AS (SELECT cls, proto, sqrt(sum(x * x)) AS norm FROM ps GROUP BY ALL),
pu AS (SELECT cls, proto, context, x / norm AS x FROM ps JOIN pn USING (cls, proto)),
wn AS (SELECT word, sqrt(sum(x * x)) AS norm FROM vc GROUP BY word),
wd AS (SELECT word, cls, proto, sum(vc.x * pu.x) AS d FROM vc JOIN pu USING (context) GROUP BY ALL),
kn AS (SELECT doc_id, pos, count(*) AS k FROM tk JOIN wn USING (word) GROUP BY ALL),
sm AS (SELECT doc_id, pos, cls, proto, sum(d) AS s FROM tk JOIN wd USING (word) GROUP BY ALL),
cl AS (SELECT doc_id, pos, cls, max(round(s / k, 9)) AS c FROM sm JOIN kn USING (doc_id, pos) GROUP BY ALL),
ev AS (SELECT st.doc_id, st.pos, CAST({TQ._lang_code('st.lang')} AS INTEGER) AS gold, CAST(q.i AS INTEGER) AS label, coalesce(cl.c, 0) AS c
       FROM st CROSS JOIN range({len(TQ.LANG_SEEDS)}) q(i)
       LEFT JOIN cl ON cl.doc_id = st.doc_id AND cl.pos = st.pos AND cl.cls = q.i),
wv AS (SELECT doc_id, pos, gold, label, c AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY c DESC, label) AS rn FROM ev) WHERE rn = 1)"""


def _head_ctes(name: str, train: str, label: str, k: int, gamma: float = 0.0, q: float | None = None,
               reg: float = GD["reg"], step: float = GD["step"]) -> str:
    """Full-batch gradient descent of a softmax head, one CTE chain per step;
    ``train`` is (vec_id, v, label).  The result is ``{name}_w`` (cls, d, w), d = 0 the bias."""
    n = name
    factor = (f"pow(py, {q!r}::DOUBLE)" if q is not None else f"pow(1 - py, {gamma!r}::DOUBLE)" if gamma else "1.0::DOUBLE")
    ctes = [f"""{n}_x AS MATERIALIZED (
    SELECT vec_id, CAST({label} AS INTEGER) AS y, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM {train}
    UNION ALL SELECT vec_id, CAST({label} AS INTEGER), 1.0, 0 FROM {train})""",
            f"{n}_n AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM {train})",
            f"""{n}_w0 AS MATERIALIZED (SELECT CAST(c AS INTEGER) AS cls, d, 0.0::DOUBLE AS w, 0.0::DOUBLE AS vel
    FROM range({k}) r(c), (SELECT DISTINCT d FROM {n}_x))"""]
    for i in range(GD["iters"]):
        ctes.append(f"""{n}_z{i} AS MATERIALIZED (
    SELECT vec_id, y, cls, sum(x * w) AS z FROM {n}_x JOIN {n}_w{i} USING (d) GROUP BY vec_id, y, cls),
{n}_p{i} AS MATERIALIZED (SELECT vec_id, y, cls, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM (
    SELECT vec_id, y, cls, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM {n}_z{i})),
{n}_g{i} AS MATERIALIZED (
    SELECT p.vec_id, p.cls, (p.p - CASE WHEN p.cls = p.y THEN 1 ELSE 0 END) * f.f AS g
    FROM {n}_p{i} p JOIN (SELECT vec_id, {factor} AS f FROM (SELECT vec_id, p AS py FROM {n}_p{i} WHERE cls = y)) f
    USING (vec_id)),
{n}_w{i + 1} AS MATERIALIZED (
    SELECT cls, d, w + nv AS w, nv AS vel FROM (
        SELECT w.cls, w.d, w.w, {GD_MOMENTUM!r}::DOUBLE * w.vel - {step!r}::DOUBLE
               * (s.g / (SELECT n FROM {n}_n) + CASE WHEN w.d > 0 THEN {reg!r}::DOUBLE * w.w ELSE 0.0 END) AS nv
        FROM {n}_w{i} w JOIN (SELECT cls, d, sum(x * g) AS g FROM {n}_g{i} JOIN {n}_x USING (vec_id) GROUP BY cls, d) s
        USING (cls, d)))""")
    ctes.append(f"{n}_w AS MATERIALIZED (SELECT cls, d, w FROM {n}_w{GD['iters']})")
    return ",\n".join(ctes)


def _predict_cte(name: str, rows: str) -> str:
    """``{name}_l`` (vec_id, cls, z) and ``{name}_b`` (vec_id, pred) of (vec_id, v) rows."""
    return f"""{name}_r AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM {rows}
             UNION ALL SELECT vec_id, 1.0, 0 FROM {rows}),
{name}_l AS MATERIALIZED (SELECT vec_id, cls, sum(x * w) AS z FROM {name}_r JOIN {name}_w USING (d) GROUP BY vec_id, cls),
{name}_b AS (SELECT vec_id, cls AS pred FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, cls) AS rn FROM {name}_l) WHERE rn = 1)"""


_WEAK = f"""weak AS MATERIALIZED (SELECT l.vec_id, t.v, l.aspect, l.polarity FROM ({EQ.LABELS_SQL}) l JOIN t USING (vec_id))"""


def _joint_cte(gamma_a: float, gamma_p: float, q: float | None = None) -> str:
    return ",\n" + ",\n".join([
        _WEAK, _head_ctes("ha", "weak", "aspect", EQ.N_ASPECTS, gamma_a, q),
        _head_ctes("hp", "weak", "polarity", 2, gamma_p, q), _predict_cte("ha", "t"), _predict_cte("hp", "t"),
        """heads AS (SELECT t.vec_id, t.gold_aspect, a.pred AS aspect, t.gold_polarity, p.pred AS polarity
          FROM t JOIN ha_b a USING (vec_id) JOIN hp_b p USING (vec_id))"""])


_HEADS_REPORT = EQ.REPORT_SQL.replace("FROM scored", "FROM heads")


def _ablation_sql() -> str:
    """The three variants' reports, each from its own chain, as summary rows."""
    def summary(variant: str, query: str) -> str:
        return f"""
SELECT '{variant}' AS variant, kind, max(CASE WHEN label = 'accuracy' THEN f1 END) AS accuracy,
       max(CASE WHEN label = 'macro avg' THEN precision END) AS precision,
       max(CASE WHEN label = 'macro avg' THEN recall END) AS recall,
       max(CASE WHEN label = 'macro avg' THEN f1 END) AS f1_score
FROM ({query}) GROUP BY kind"""
    return "\nUNION ALL".join([
        summary("none", EQ._with(_joint_cte(GAMMA_ASPECT, GAMMA_POLARITY) + "," + _HEADS_REPORT)),
        summary("without_focal_loss", EQ._with(_joint_cte(0.0, 0.0, GCE_Q) + "," + _HEADS_REPORT)),
        summary("without_deep_learning", EQ._with("," + EQ.REPORT_SQL))])


def _search_sql() -> str:
    grid = [(g, r, s) for g in SEARCH_SPACE["gamma"] for r in SEARCH_SPACE["reg"] for s in SEARCH_SPACE["step"]]
    trials = random.Random(SEARCH_SEED).sample(grid, min(SEARCH_TRIALS, len(grid)))
    u = "('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0"
    ctes = [_WEAK, f"tr AS MATERIALIZED (SELECT * FROM weak WHERE {u} < {TRAIN_FRACTION})",
            f"va AS MATERIALIZED (SELECT * FROM weak WHERE {u} >= {TRAIN_FRACTION})"]
    rows = []
    for i, (g, r, s) in enumerate(trials):
        n = f"h{i}"
        ctes += [_head_ctes(n, "tr", "aspect", EQ.N_ASPECTS, float(g), None, float(r), float(s)), _predict_cte(n, "va"),
                 f"""{n}_v AS (SELECT l.vec_id, l.cls, va.aspect AS y, l.z - ln(sum(exp(l.z)) OVER (PARTITION BY l.vec_id)) AS lp
                 FROM {n}_l l JOIN va USING (vec_id))"""]
        rows.append(f"""
SELECT {i} AS trial, {float(g)!r}::DOUBLE AS gamma, {float(r)!r}::DOUBLE AS reg, {float(s)!r}::DOUBLE AS step,
       round(avg(-pow(1 - exp(lp), {float(g)!r}::DOUBLE) * lp), 6) AS val_loss,
       (SELECT round(avg(CASE WHEN b.pred = va.aspect THEN 1.0::DOUBLE ELSE 0.0 END), 6) FROM {n}_b b JOIN va USING (vec_id))
       AS val_accuracy
FROM {n}_v WHERE cls = y""")
    return EQ._with(",\n" + ",\n".join(ctes) + "\nUNION ALL".join(rows))


ORACLE = {
    "word_vector_labels": _word_vector_cte() + "\nSELECT doc_id, pos, label, round(score, 6) AS score, gold FROM wv",
    "word_vector_report": _word_vector_cte() + "," + TQ._report_sql("wv"),
    "word_vector_seed_report": _word_vector_cte(True) + "," + TQ._report_sql("wv"),
    "class_neighbours": _word_vector_cte() + """
SELECT CAST(cls AS INTEGER) AS cls, CAST(rank AS INTEGER) AS rank, word, similarity FROM (
    SELECT cls, word, similarity, row_number() OVER (PARTITION BY cls ORDER BY similarity DESC, word) AS rank
    FROM (SELECT cls, word, round(d / norm, 6) AS similarity FROM wd JOIN wn USING (word))) WHERE rank <= 10""",
    "joint_classifier": EQ._with(_joint_cte(GAMMA_ASPECT, GAMMA_POLARITY) + "," + _HEADS_REPORT),
    "ablation_results": _ablation_sql(),
    "hyper_search": _search_sql(),
}
