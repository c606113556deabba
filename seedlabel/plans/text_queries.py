"""Sentence splitting, keyword and one-step seed-word labelling on ``documents``.

Domain set-up (fixed parameters of these queries): the classes are the four
languages, in this order, and each class has four seed words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedlabel.functions.bag_udf import bag_scores, doc_bag_sums
from seedlabel.functions.bags import argmax_first, bag_weights
from seedlabel.functions.text import sentence_pieces, tokens
from seedlabel.operators import keywords, metrics
from seedlabel.operators.sentences import sentence_stats, split_lines, split_sentences
from seedlabel.session import load_table, spread

# Fixed query parameters: class list (order = label encoding) and seed words.
LANGS = ["en", "fr", "de", "es"]
LANG_SEEDS = [
    ["the", "of", "and", "to"],
    ["le", "les", "et", "des"],
    ["der", "die", "und", "das"],
    ["el", "los", "y", "del"],
]
ONE_STEP_THRESHOLD = 0.3
DOC_LOGIT_THRESHOLD = 2.0
# Two polarity classes over the same sentences: negations and conjunctions of the four languages.
POLARITY_SEEDS = [["not", "pas", "nicht", "no"], ["and", "et", "und", "y"]]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load_table(spark, sf_dir, "documents"))


def sentences(spark, sf_dir, keep=("lang",)) -> DataFrame:
    return split_sentences(documents(spark, sf_dir), "doc_id", "text", keep=keep)


def class_bags():
    return [bag_weights(s) for s in LANG_SEEDS]


def q_sentence_split(spark, sf_dir):
    return sentences(spark, sf_dir, keep=()).select("doc_id", "pos", "sentence")


def q_sentence_stats(spark, sf_dir):
    return sentence_stats(sentences(spark, sf_dir), ["lang"])


def keyword_lines(spark, sf_dir) -> DataFrame:
    lines = split_lines(documents(spark, sf_dir), "doc_id", "text", keep=["lang"])
    return lines.select("doc_id", "line_no", keywords.encode_labels("lang", LANGS).alias("gold"),
                        tokens("line").alias("tokens"))


def q_keyword_labels(spark, sf_dir):
    return keywords.keyword_labels(keyword_lines(spark, sf_dir), "tokens", LANG_SEEDS) \
        .select("doc_id", "line_no", "label", "gold")


def q_keyword_conflicts(spark, sf_dir):
    return keywords.keyword_match_counts(keyword_lines(spark, sf_dir), "tokens", LANG_SEEDS, ["gold"])


def q_keyword_report(spark, sf_dir):
    return metrics.classification_report(q_keyword_labels(spark, sf_dir), "gold", "label")


def one_step_scored(spark, sf_dir) -> DataFrame:
    s = sentences(spark, sf_dir).withColumn("_cos", bag_scores(class_bags())(tokens("sentence")))
    return s.select("doc_id", "pos", keywords.encode_labels("lang", LANGS).alias("gold"),
                    argmax_first("_cos").alias("label"), F.round(F.array_max("_cos"), 6).alias("score"))


def q_one_step_labels(spark, sf_dir):
    return one_step_scored(spark, sf_dir).filter(F.col("score") >= ONE_STEP_THRESHOLD) \
        .select("doc_id", "pos", "label", "score", "gold")


def q_one_step_report(spark, sf_dir):
    """Every gold sentence is evaluated by its best class, without a threshold."""
    return metrics.classification_report(one_step_scored(spark, sf_dir), "gold", "label")


def q_document_aspects(spark, sf_dir):
    """Per document: split, score every sentence against every class, sum the
    sentence scores per class and keep classes whose sum passes the threshold.
    The sentences of a document live in its own row, so this is map-only."""
    per_sentence_tokens = F.transform(sentence_pieces("text"), lambda s: tokens(s))
    sums = doc_bag_sums(class_bags())(per_sentence_tokens)
    d = documents(spark, sf_dir).select("doc_id", F.posexplode(sums).alias("label", "logit_sum"))
    d = d.select("doc_id", F.col("label").cast("int"), F.round("logit_sum", 6).alias("logit_sum"))
    return d.filter(F.col("logit_sum") > DOC_LOGIT_THRESHOLD)


def q_document_polarity(spark, sf_dir):
    """Aspects of a document as above, each with the document's polarity: the
    polarity class whose sentence scores sum highest (the first of ties);
    both sums come from the document's own row."""
    per_sentence_tokens = F.transform(sentence_pieces("text"), lambda s: tokens(s))
    polarity_bags = [{w: 1.0 for w in seeds} for seeds in POLARITY_SEEDS]
    d = documents(spark, sf_dir).select("doc_id", doc_bag_sums(class_bags())(per_sentence_tokens).alias("aspects"),
                                        doc_bag_sums(polarity_bags)(per_sentence_tokens).alias("polarities"))
    d = d.select("doc_id", F.transform("polarities", lambda x: F.round(x, 9)).alias("polarities"),
                 F.posexplode("aspects").alias("label", "logit_sum"))
    d = d.select("doc_id", F.col("label").cast("int"), F.round("logit_sum", 6).alias("logit_sum"),
                 argmax_first("polarities").alias("polarity"))
    return d.filter(F.col("logit_sum") > DOC_LOGIT_THRESHOLD)


def q_conversation_aspects(spark, sf_dir):
    """Multi-label classes of a whole conversation: every turn is split into
    sentences, each sentence scored against every class, the sentence scores
    summed per conversation (partial aggregate over its turns) and classes
    above the threshold kept."""
    from seedlabel.operators.classifier import sum_and_threshold
    conv = spread(load_table(spark, sf_dir, "conversations"))
    per_turn = conv.select("conv_id", doc_bag_sums(class_bags())(
        F.transform(sentence_pieces("text"), lambda s: tokens(s))).alias("logits"))
    out = sum_and_threshold(per_turn, "conv_id", "logits", DOC_LOGIT_THRESHOLD)
    return out.select("conv_id", "label", F.round("logit_sum", 6).alias("logit_sum"))


# ---------------------------------------------------------------------------
# Oracle SQL (DuckDB)

WS = r"\s+"
SENTENCES_CTE = r"""
sents AS (SELECT doc_id, lang, CAST(i - 1 AS INTEGER) AS pos, sentence FROM (
    SELECT doc_id, lang, unnest(p) AS sentence, generate_subscripts(p, 1) AS i FROM (
        SELECT doc_id, lang, list_transform(
            list_filter(regexp_split_to_array(lower(text), '; |\. |! |\n| \?'), lambda x: x <> ''),
            lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS p
        FROM documents)))"""

LINES_CTE = r"""
lines AS (SELECT doc_id, lang, CAST(i - 1 AS INTEGER) AS line_no, line FROM (
    SELECT doc_id, lang, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
        SELECT doc_id, lang, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM documents)))"""


def _lang_code(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{x}' THEN {i}" for i, x in enumerate(LANGS)) + " ELSE -1 END"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _matched_sql() -> str:
    parts = " || ".join(f"CASE WHEN list_has_any(t, {_list(s)}) THEN [{i}] ELSE [] END"
                        for i, s in enumerate(LANG_SEEDS))
    return parts


KEYWORD_CTE = LINES_CTE + rf""",
kt AS (SELECT doc_id, line_no, CAST({_lang_code('lang')} AS INTEGER) AS gold,
              list_filter(regexp_split_to_array(line, '{WS}'), lambda x: x <> '') AS t FROM lines),
km AS (SELECT doc_id, line_no, gold, {_matched_sql()} AS m FROM kt),
kl AS (SELECT doc_id, line_no, CAST(m[1] AS INTEGER) AS label, gold FROM km WHERE len(m) = 1)"""


def _cos_terms() -> str:
    out = []
    for i, seeds in enumerate(LANG_SEEDS):
        b = bag_weights(seeds)
        qn = sum(v * v for v in b.values()) ** 0.5
        dot = " + ".join(f"{v} * len(list_filter(t, lambda x: x = '{w}'))" for w, v in sorted(b.items()))
        out.append(f"CASE WHEN ss > 0 THEN ({dot}) / (sqrt(ss) * {qn}) ELSE 0.0 END AS c{i}")
    return ",\n       ".join(out)


SCORED_SENTENCES_CTE = SENTENCES_CTE + rf""",
st AS (SELECT doc_id, pos, lang, list_filter(regexp_split_to_array(sentence, '{WS}'), lambda x: x <> '') AS t
       FROM sents),
sq AS (SELECT doc_id, pos, sum(c * c) AS ss FROM (
        SELECT doc_id, pos, w, count(*) AS c FROM (SELECT doc_id, pos, unnest(t) AS w FROM st) GROUP BY ALL)
       GROUP BY ALL),
sc AS (SELECT st.doc_id, st.pos, st.lang, coalesce(sq.ss, 0) AS ss, st.t FROM st LEFT JOIN sq USING (doc_id, pos)),
cs AS (SELECT doc_id, pos, lang, {_cos_terms()} FROM sc),
lng AS (""" + " UNION ALL ".join(f"SELECT doc_id, pos, lang, {i} AS label, c{i} AS c FROM cs" for i in range(len(LANGS))) + """),
best AS (SELECT doc_id, pos, CAST(""" + _lang_code('lang') + """ AS INTEGER) AS gold, CAST(label AS INTEGER) AS label,
         round(c, 6) AS score FROM (
         SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY c DESC, label) AS rn FROM lng) WHERE rn = 1)"""


def _report_sql(src: str) -> str:
    return f"""
cm AS (SELECT gold AS actual, label AS pred, count(*) AS n FROM {src} GROUP BY ALL),
cls AS (SELECT actual AS cls FROM cm UNION SELECT pred FROM cm),
per AS (SELECT c.cls,
        coalesce((SELECT sum(n) FROM cm WHERE cm.actual = c.cls), 0) AS support,
        coalesce((SELECT sum(n) FROM cm WHERE cm.pred = c.cls), 0) AS pred_n,
        coalesce((SELECT sum(n) FROM cm WHERE cm.pred = c.cls AND cm.actual = c.cls), 0) AS tp FROM cls c),
m AS (SELECT cls, support, tp,
        CASE WHEN pred_n = 0 THEN 0.0 ELSE tp / pred_n END AS precision,
        CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
        CASE WHEN support + pred_n = 0 THEN 0.0 ELSE 2 * tp / (support + pred_n) END AS f1 FROM per)
SELECT CAST(cls AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM m"""


def _doc_aspects_sql() -> str:
    return "WITH " + SCORED_SENTENCES_CTE + f""",
ds AS (SELECT doc_id, label, round(sum(c), 6) AS logit_sum FROM lng GROUP BY doc_id, label)
SELECT doc_id, CAST(label AS INTEGER) AS label, logit_sum FROM ds WHERE logit_sum > {DOC_LOGIT_THRESHOLD}"""


def _conv_aspects_sql() -> str:
    cte = SCORED_SENTENCES_CTE.replace("FROM documents", "FROM (SELECT conv_id * 100000 + turn AS doc_id, 'x' AS lang, "
                                                          "text FROM conversations)")
    return "WITH " + cte + f""",
cs2 AS (SELECT doc_id // 100000 AS conv_id, label, sum(c) AS s FROM lng GROUP BY ALL)
SELECT conv_id, CAST(label AS INTEGER) AS label, round(s, 6) AS logit_sum FROM cs2 WHERE s > {DOC_LOGIT_THRESHOLD}"""


def _doc_polarity_sql() -> str:
    cos = ", ".join("CASE WHEN ss > 0 THEN (" + " + ".join(f"len(list_filter(t, lambda x: x = '{w}'))" for w in seeds)
                    + f") / (sqrt(ss) * sqrt({float(len(seeds))!r})) ELSE 0.0 END AS p{k}"
                    for k, seeds in enumerate(POLARITY_SEEDS))
    return "WITH " + SCORED_SENTENCES_CTE + f""",
ds AS (SELECT doc_id, label, sum(c) AS s FROM lng GROUP BY doc_id, label),
pl AS (SELECT doc_id, CAST(CASE WHEN round(sum(p1), 9) > round(sum(p0), 9) THEN 1 ELSE 0 END AS INTEGER) AS polarity
       FROM (SELECT doc_id, {cos} FROM sc) GROUP BY doc_id)
SELECT ds.doc_id, CAST(label AS INTEGER) AS label, round(s, 6) AS logit_sum, polarity
FROM ds JOIN pl USING (doc_id) WHERE s > {DOC_LOGIT_THRESHOLD}"""


QUERIES = {
    "document_polarity": q_document_polarity,
    "sentence_split": q_sentence_split,
    "sentence_stats": q_sentence_stats,
    "keyword_labels": q_keyword_labels,
    "keyword_conflicts": q_keyword_conflicts,
    "keyword_report": q_keyword_report,
    "one_step_labels": q_one_step_labels,
    "one_step_report": q_one_step_report,
    "document_aspects": q_document_aspects,
    "conversation_aspects": q_conversation_aspects,
}

ORACLE = {
    "sentence_split": "WITH " + SENTENCES_CTE + "\nSELECT doc_id, pos, sentence FROM sents",
    "sentence_stats": "WITH " + SENTENCES_CTE + rf"""
SELECT lang, count(*) AS sentences, count(*) FILTER (WHERE sentence = '') AS empty_sentences,
       CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 6) AS avg_tokens, CAST(max(n) AS BIGINT) AS max_tokens
FROM (SELECT lang, sentence, len(list_filter(regexp_split_to_array(sentence, '{WS}'), lambda x: x <> '')) AS n
      FROM sents) GROUP BY lang""",
    "keyword_labels": "WITH " + KEYWORD_CTE + "\nSELECT * FROM kl",
    "keyword_conflicts": "WITH " + KEYWORD_CTE + """
SELECT gold, CAST(len(m) AS INTEGER) AS n_matched, count(*) AS lines FROM km GROUP BY ALL""",
    "keyword_report": "WITH " + KEYWORD_CTE + "," + _report_sql("kl"),
    "one_step_labels": "WITH " + SCORED_SENTENCES_CTE + f"""
SELECT doc_id, pos, label, score, gold FROM best WHERE score >= {ONE_STEP_THRESHOLD}""",
    "one_step_report": "WITH " + SCORED_SENTENCES_CTE + "," + _report_sql("best"),
    "document_aspects": _doc_aspects_sql(),
    "document_polarity": _doc_polarity_sql(),
    "conversation_aspects": _conv_aspects_sql(),
}
