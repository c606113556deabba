"""Gold-set preparation, splits and model comparison on the tabular tables.

* Opinion rows: each order is a "sentence", each of its line items an
  "opinion"; the part's type is the aspect group and the last word of its
  name the sub-aspect (category ``TYPE#word``); the return flag gives the
  polarity (A positive, R negative, N neutral); a zero discount marks an
  implicit target.
* Model comparison: order priorities are the "models", order status the
  "task", total price the metric of each run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.operators import opinions as O
from seedlabel.operators import significance as S
from seedlabel.operators import splits as SP
from seedlabel.plans import text_queries as TQ
from seedlabel.session import load_table

# Fixed query parameters.
GROUP_CODES = {"SMALL": 0, "MEDIUM": 1, "LARGE": 2, "ECONOMY": 3, "STANDARD": 4}
EXCLUDED_GROUPS = ["PROMO"]
POLARITY_CODES = {"positive": 1, "negative": 0}
VALIDATION_ROWS = 100
MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def opinion_rows(spark, sf_dir) -> DataFrame:
    """One row per line item shaped as an opinion; ``opinion_count`` (lines of
    the order) is filled in by the per-sentence aggregate."""
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag",
                                                       "l_discount")
    pt = load_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    j = li.join(pt, li.l_partkey == pt.p_partkey)
    pol = (F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "negative")
           .otherwise("neutral"))
    return j.select(F.col("l_orderkey").alias("sentence_index"), F.col("l_linenumber").alias("opinion_num"),
                    F.lit(None).cast("long").alias("opinion_count"),
                    pol.alias("polarity"),
                    F.when(F.col("l_discount") == 0, F.lit("NULL")).otherwise(F.col("p_name")).alias("target"),
                    F.concat_ws("#", "p_type", F.element_at(F.split("p_name", " "), -1)).alias("category"))


def q_opinion_gold_set(spark, sf_dir):
    gold, _ = O.gold_set(opinion_rows(spark, sf_dir), GROUP_CODES, POLARITY_CODES, exclude=EXCLUDED_GROUPS)
    return gold.select("sentence_index", F.col("aspect_code").cast("int").alias("aspect_group"),
                       F.col("polarity_code").cast("int").alias("polarity"), "opinion_count", "imp")


def q_opinion_share(spark, sf_dir):
    _, f = O.gold_set(opinion_rows(spark, sf_dir), GROUP_CODES, POLARITY_CODES, exclude=EXCLUDED_GROUPS)
    return O.shares(f)


def q_corpus_split(spark, sf_dir):
    d = TQ.documents(spark, sf_dir).filter(F.length(F.coalesce("text", F.lit(""))) > 0)
    return SP.corpus_split(d.select("doc_id", SP.hash_uniform("doc_id").alias("u")), "doc_id")


def q_exact_count_split(spark, sf_dir):
    # the labels feed the top-n and the join: computed once
    lab = TQ.q_keyword_labels(spark, sf_dir).select("doc_id", "line_no").checkpoint(eager=True)
    return SP.exact_count_split(lab.withColumn("u", SP.hash_uniform("doc_id", "line_no")), ["doc_id", "line_no"],
                                VALIDATION_ROWS)


def _stats(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders")
    return S.model_stats(o, ["o_orderstatus"], "o_orderpriority", "o_totalprice")


def q_ttest_pairs(spark, sf_dir):
    t = S.pair_tests(_stats(spark, sf_dir), ["o_orderstatus"])
    return t.select("o_orderstatus", "model_a", "model_b", "n_a", "n_b", F.round("t", 6).alias("t"), "df")


def q_holm_adjusted(spark, sf_dir):
    a = S.adjust(S.pair_tests(_stats(spark, sf_dir), ["o_orderstatus"]), ["o_orderstatus"])
    return a.select("o_orderstatus", "model_a", "model_b", F.round("t", 6).alias("t"), "df",
                    *[F.round(c, 6).alias(c) for c in ("p", "p_bonferroni", "p_holm")])


def q_pvalue_matrix(spark, sf_dir):
    a = S.adjust(S.pair_tests(_stats(spark, sf_dir), ["o_orderstatus"]), ["o_orderstatus"])
    m = S.pvalue_matrix(a, ["o_orderstatus"], MODELS)
    return m.select("o_orderstatus", "model_a", *[F.round(f"`{c}`", 6).alias(c) for c in MODELS])


# ---------------------------------------------------------------------------
# Oracle SQL (DuckDB)

_CODES = "CASE " + " ".join(f"WHEN aspect_group = '{k}' THEN {v}" for k, v in GROUP_CODES.items()) + " END"
OPINION_CTE = f"""
j AS (SELECT l.l_orderkey AS sentence_index, l.l_linenumber AS opinion_num,
             count(*) OVER (PARTITION BY l.l_orderkey) AS opinion_count,
             CASE WHEN l.l_returnflag = 'A' THEN 'positive' WHEN l.l_returnflag = 'R' THEN 'negative'
                  ELSE 'neutral' END AS polarity,
             CASE WHEN l.l_discount = 0 THEN 'NULL' ELSE p.p_name END AS target,
             p.p_type || '#' || string_split(p.p_name, ' ')[-1] AS category
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
o AS (SELECT *, string_split(category, '#')[1] AS aspect_group, target <> 'NULL' AS imp FROM j),
d AS (SELECT * FROM o WHERE aspect_group NOT IN ({", ".join(f"'{g}'" for g in EXCLUDED_GROUPS)})),
c AS (SELECT *, count(*) OVER (PARTITION BY sentence_index) AS new_count,
                count(*) OVER (PARTITION BY sentence_index, aspect_group) AS uniform_count FROM d),
f AS (SELECT * FROM c WHERE new_count = opinion_count AND new_count = uniform_count AND polarity <> 'neutral'
      AND opinion_num = 1)"""

_U = "('0x' || substr(md5({k}), 1, 8))::BIGINT / 4294967296.0"

STATS_CTE = """
s AS (SELECT o_orderstatus, o_orderpriority AS model, count(*) AS n, avg(o_totalprice) AS mean,
             var_samp(o_totalprice) AS var FROM orders GROUP BY ALL)"""

# p of the one-sided test: the t density integrated from 0 to |t| by Simpson's rule
ADJUSTED_CTE = "WITH " + STATS_CTE + """,
tt AS (SELECT a.o_orderstatus, a.model AS model_a, b.model AS model_b, CAST(a.n + b.n - 2 AS BIGINT) AS df,
              (a.mean - b.mean) / sqrt((((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2))
              * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)) AS t
       FROM s a JOIN s b USING (o_orderstatus)),
area AS (SELECT o_orderstatus, model_a, model_b,
                sum((CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                    * exp(-(df + 1) / 2.0::DOUBLE * ln(1 + pow(abs(t) * i / 4000.0::DOUBLE, 2) / df)))
                * abs(any_value(t)) / 12000.0::DOUBLE AS x
         FROM tt, range(4001) r(i) GROUP BY ALL),
pv AS (SELECT tt.*, 0.5::DOUBLE + sign(t) * x * exp(lgamma((df + 1) / 2.0::DOUBLE) - lgamma(df / 2.0::DOUBLE))
              / sqrt(df * pi()) AS p FROM tt JOIN area USING (o_orderstatus, model_a, model_b)),
k AS (SELECT o_orderstatus, count(*) AS k FROM s GROUP BY o_orderstatus),
hr AS (SELECT o_orderstatus, model_a, model_b, p,
              (count(*) OVER (PARTITION BY o_orderstatus) - row_number() OVER g + 1) * p AS raw
       FROM pv WHERE model_a <> model_b WINDOW g AS (PARTITION BY o_orderstatus ORDER BY p, model_a, model_b)),
hm AS (SELECT o_orderstatus, model_a, model_b, least(max(raw) OVER (PARTITION BY o_orderstatus
              ORDER BY p, model_a, model_b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0::DOUBLE) AS p_holm
       FROM hr),
adj AS (SELECT pv.*, least(p * (k * (k - 1) / 2.0::DOUBLE), 1.0::DOUBLE) AS p_bonferroni, hm.p_holm
        FROM pv JOIN k USING (o_orderstatus) LEFT JOIN hm USING (o_orderstatus, model_a, model_b))"""

_MATRIX = ", ".join(f"""round(max(CASE WHEN model_b = '{m}' THEN CASE WHEN model_a = model_b THEN 1.0::DOUBLE
       ELSE p_holm END END), 6) AS "{m}\"""" for m in MODELS)

QUERIES = {
    "opinion_gold_set": q_opinion_gold_set,
    "opinion_share": q_opinion_share,
    "corpus_split": q_corpus_split,
    "exact_count_split": q_exact_count_split,
    "ttest_pairs": q_ttest_pairs,
    "holm_adjusted": q_holm_adjusted,
    "pvalue_matrix": q_pvalue_matrix,
}

ORACLE = {
    "opinion_gold_set": "WITH " + OPINION_CTE + f"""
SELECT sentence_index, CAST({_CODES} AS INTEGER) AS aspect_group,
       CAST(CASE polarity WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 END AS INTEGER) AS polarity,
       opinion_count, imp FROM f""",
    "opinion_share": "WITH " + OPINION_CTE + """
SELECT 'polarity' AS dim, polarity AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
FROM f GROUP BY polarity
UNION ALL
SELECT 'aspect_group', aspect_group, count(*), round(100.0 * count(*) / sum(count(*)) OVER (), 6) FROM f
GROUP BY aspect_group""",
    "corpus_split": f"""
WITH d AS (SELECT doc_id, {_U.format(k='CAST(doc_id AS VARCHAR)')} AS u FROM documents WHERE length(coalesce(text, '')) > 0),
b AS (SELECT doc_id, CASE WHEN u < 0.8 THEN (CASE WHEN u < 0.0005 THEN 'test' ELSE 'train' END) ELSE 'test' END AS b
      FROM d),
t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM b WHERE b = 'test')
SELECT doc_id, 'train' AS split FROM b WHERE b = 'train'
UNION ALL
SELECT doc_id, CASE WHEN i < floor(n * 0.05) THEN 'dev' ELSE 'weak' END FROM t""",
    "exact_count_split": "WITH " + TQ.KEYWORD_CTE + f""",
u AS (SELECT doc_id, line_no, {_U.format(k="CAST(doc_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR)")} AS u FROM kl),
v AS (SELECT doc_id, line_no FROM u ORDER BY u, doc_id, line_no LIMIT {VALIDATION_ROWS})
SELECT u.doc_id, u.line_no, CASE WHEN v.doc_id IS NULL THEN 'train' ELSE 'validation' END AS split
FROM u LEFT JOIN v USING (doc_id, line_no)""",
    "ttest_pairs": "WITH " + STATS_CTE + """
SELECT a.o_orderstatus, a.model AS model_a, b.model AS model_b, a.n AS n_a, b.n AS n_b,
       round((a.mean - b.mean) / sqrt((((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2))
             * (1.0 / a.n + 1.0 / b.n)), 6) AS t,
       CAST(a.n + b.n - 2 AS BIGINT) AS df
FROM s a JOIN s b USING (o_orderstatus)""",
    "holm_adjusted": ADJUSTED_CTE + """
SELECT o_orderstatus, model_a, model_b, round(t, 6) AS t, df, round(p, 6) AS p, round(p_bonferroni, 6) AS p_bonferroni,
       round(p_holm, 6) AS p_holm FROM adj""",
    "pvalue_matrix": ADJUSTED_CTE + f"""
SELECT o_orderstatus, model_a, {_MATRIX} FROM adj GROUP BY o_orderstatus, model_a""",
}
