"""Seed-word labelers on the sentences of ``documents``: two-step
(representative sentences) and nearest-sentence-per-seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.functions.bag_udf import bag_scores
from seedlabel.functions.text import tokens
from seedlabel.operators import metrics
from seedlabel.operators import representatives as R
from seedlabel.operators.keywords import encode_labels
from seedlabel.plans import text_queries as TQ

# Fixed query parameters.
N_REPRESENTATIVES = 5
TWO_STEP_THRESHOLD = 0.3
MIN_WORDS_NEAREST = 4


def seed_sentences(spark, sf_dir) -> DataFrame:
    s = TQ.sentences(spark, sf_dir).withColumn("tokens", tokens("sentence"))
    return s.select("doc_id", "pos", encode_labels("lang", TQ.LANGS).alias("gold"), "sentence", "tokens",
                    F.size("tokens").alias("n_words"))


def _rows(sent: DataFrame) -> DataFrame:
    scored = sent.withColumn("scores", bag_scores(TQ.class_bags())(F.col("tokens")))
    return R.class_rows(scored, TQ.LANG_SEEDS)


def q_seed_word_representatives(spark, sf_dir):
    return R.representatives(_rows(seed_sentences(spark, sf_dir)), TQ.LANG_SEEDS, N_REPRESENTATIVES)


def q_nearest_to_seed(spark, sf_dir):
    n = R.nearest_to_seeds(seed_sentences(spark, sf_dir), TQ.LANG_SEEDS, MIN_WORDS_NEAREST)
    return n.select("cls", "seed_pos", "doc_id", "pos", F.round("score", 6).alias("score"))


def two_step_scored(spark, sf_dir) -> DataFrame:
    # the sentence table feeds the candidate job and the final scoring: split
    # once and cut the lineage with a reliable checkpoint
    sent = seed_sentences(spark, sf_dir).checkpoint(eager=True)
    reps = R.representatives(_rows(sent), TQ.LANG_SEEDS, N_REPRESENTATIVES)
    near = R.nearest_to_seeds(sent, TQ.LANG_SEEDS, MIN_WORDS_NEAREST, keep=("sentence",))
    # both results are bounded by classes x (N + 1 + seeds) rows; one job
    # collects both (the scan exchange is shared by the two branches)
    both = (reps.select(F.lit("rep").alias("k"), "cls", "sentence")
            .unionByName(near.select(F.lit("near").alias("k"), "cls", "sentence")).collect())
    rep_rows = [(r.cls, r.sentence) for r in both if r.k == "rep"]
    near_rows = [(r.cls, r.sentence) for r in both if r.k == "near"]
    bags = R.prototype_bags(rep_rows, near_rows, len(TQ.LANGS))
    return R.score_with_bags(sent, "tokens", bags)


def q_two_step_labels(spark, sf_dir):
    s = two_step_scored(spark, sf_dir).filter(F.col("score") >= TWO_STEP_THRESHOLD)
    return s.select("doc_id", "pos", "label", F.round("score", 6).alias("score"), "gold")


def q_two_step_report(spark, sf_dir):
    """Every gold sentence is evaluated by its best class, without a threshold."""
    return metrics.classification_report(two_step_scored(spark, sf_dir), "gold", "label")


_SEEDS = ", ".join(f"({c}, {p}, '{w}')" for c, seeds in enumerate(TQ.LANG_SEEDS) for p, w in enumerate(seeds))

QUERIES = {
    "seed_word_representatives": q_seed_word_representatives,
    "nearest_to_seed": q_nearest_to_seed,
    "two_step_labels": q_two_step_labels,
    "two_step_report": q_two_step_report,
}

NEAREST_CTE = f"""
sd(cls, seed_pos, word) AS (VALUES {_SEEDS}),
x AS (SELECT sd.cls, sd.seed_pos, sc.doc_id, sc.pos,
             CASE WHEN sc.ss > 0 THEN len(list_filter(sc.t, lambda y: y = sd.word)) / sqrt(sc.ss) ELSE 0.0 END AS score
      FROM sc, sd WHERE len(sc.t) >= {MIN_WORDS_NEAREST}),
near AS (SELECT cls, seed_pos, doc_id, pos, score FROM (
    SELECT *, row_number() OVER (PARTITION BY cls, seed_pos ORDER BY score DESC, doc_id, pos) AS rn FROM x)
WHERE rn = 1)"""


def _representatives_cte() -> str:
    """The greedy picks: one step per seed position, then the best remaining rows."""
    def foreign(c):
        return " OR ".join(f"contains(sentence, '{w}')" for j, seeds in enumerate(TQ.LANG_SEEDS) if j != c for w in seeds)

    rows = " UNION ALL ".join(f"""
SELECT {c} AS cls, cs.doc_id, cs.pos, s.sentence, round(c{c}, 9) AS score FROM cs JOIN sents s USING (doc_id, pos)
JOIN sc USING (doc_id, pos) WHERE len(sc.t) > 1 AND NOT ({foreign(c)})""" for c in range(len(TQ.LANG_SEEDS)))
    ctes = [f"el AS ({rows})", "k0 AS (SELECT cls, -1 AS step, doc_id, pos, sentence FROM el WHERE false)"]
    for p in range(max(map(len, TQ.LANG_SEEDS))):
        seed = "CASE " + " ".join(f"WHEN cls = {c} THEN '{s[p]}'" for c, s in enumerate(TQ.LANG_SEEDS) if p < len(s)) + " END"
        ctes.append(f"""k{p + 1} AS (SELECT * FROM k{p} UNION ALL
SELECT cls, {p} AS step, doc_id, pos, sentence FROM (
    SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, doc_id, pos) AS rn FROM el
    WHERE contains(sentence, ' ' || {seed} || ' ') AND NOT EXISTS (
        SELECT 1 FROM k{p} q WHERE q.cls = el.cls AND q.sentence = el.sentence)) WHERE rn = 1)""")
    last = f"k{max(map(len, TQ.LANG_SEEDS))}"
    ctes.append(f"""fill AS (SELECT cls, 1000 + rn AS step, doc_id, pos, sentence FROM (
    SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, doc_id, pos) AS rn FROM el WHERE NOT EXISTS (
        SELECT 1 FROM {last} q WHERE q.cls = el.cls AND q.doc_id = el.doc_id AND q.pos = el.pos)) f
    WHERE rn <= {N_REPRESENTATIVES + 1} - (SELECT count(*) FROM {last} q WHERE q.cls = f.cls)),
reps AS (SELECT CAST(cls AS INTEGER) AS cls,
                CAST(row_number() OVER (PARTITION BY cls ORDER BY step) - 1 AS INTEGER) AS pick, doc_id, pos, sentence
         FROM (SELECT * FROM {last} UNION ALL SELECT * FROM fill))""")
    return ",\n".join(ctes)


REPRESENTATIVES_CTE = "WITH " + TQ.SCORED_SENTENCES_CTE + ",\n" + _representatives_cte()

TWO_STEP_CTE = REPRESENTATIVES_CTE + "," + NEAREST_CTE + """,
protos AS (SELECT cls, pick AS bag, sentence FROM reps UNION ALL
           SELECT near.cls, 100 + seed_pos AS bag, s.sentence FROM near JOIN sents s USING (doc_id, pos)),
own AS (SELECT cls, bag, w, CAST(count(*) AS DOUBLE) AS v FROM (
            SELECT cls, bag, unnest(list_filter(regexp_split_to_array(sentence, '\\s+'), lambda x: x <> '')) AS w
            FROM protos) GROUP BY ALL),
bags AS (SELECT * FROM own UNION ALL
         SELECT cls, -1 AS bag, w, sum(v) / (SELECT count(*) FROM reps r WHERE r.cls = o.cls) AS v
         FROM own o WHERE bag < 100 GROUP BY cls, w),
norms AS (SELECT cls, bag, sqrt(sum(v * v)) AS norm FROM bags GROUP BY ALL),
tc AS (SELECT doc_id, pos, w, count(*) AS c FROM (SELECT doc_id, pos, unnest(t) AS w FROM sc) GROUP BY ALL),
dots AS (SELECT tc.doc_id, tc.pos, bags.cls, bags.bag, sum(tc.c * bags.v) AS dot FROM tc JOIN bags USING (w) GROUP BY ALL),
top AS (SELECT d.doc_id, d.pos, d.cls, max(d.dot / (sqrt(sc.ss) * n.norm)) AS c
        FROM dots d JOIN norms n USING (cls, bag) JOIN sc USING (doc_id, pos) GROUP BY ALL),
every AS (SELECT b.doc_id, b.pos, b.gold, CAST(k AS INTEGER) AS label, coalesce(top.c, 0) AS c
          FROM best b CROSS JOIN range(""" + str(len(TQ.LANG_SEEDS)) + """) r(k)
          LEFT JOIN top ON top.doc_id = b.doc_id AND top.pos = b.pos AND top.cls = k),
two AS (SELECT doc_id, pos, gold, label, c AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY c DESC, label) AS rn FROM every) WHERE rn = 1)"""

ORACLE = {
    "nearest_to_seed": "WITH " + TQ.SCORED_SENTENCES_CTE + "," + NEAREST_CTE + """
SELECT CAST(cls AS INTEGER) AS cls, CAST(seed_pos AS INTEGER) AS seed_pos, doc_id, pos, round(score, 6) AS score
FROM near""",
    "seed_word_representatives": REPRESENTATIVES_CTE + "\nSELECT cls, pick, doc_id, pos, sentence FROM reps",
    "two_step_labels": TWO_STEP_CTE + f"""
SELECT doc_id, pos, label, round(score, 6) AS score, gold FROM two WHERE score >= {TWO_STEP_THRESHOLD}""",
    "two_step_report": TWO_STEP_CTE + "," + TQ._report_sql("two"),
}
