"""Models estimated on the given texts: back-off substitutes and word classes on
the turns of ``conversations``, a classifier with a hidden layer on ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.functions.text import tokens
from seedlabel.operators import backoff as B
from seedlabel.operators import embedding_cache as EC
from seedlabel.operators import hashed_embedding as E
from seedlabel.operators import metrics
from seedlabel.operators import network as N
from seedlabel.operators import vocabulary as V
from seedlabel.operators import wordclasses as H
from seedlabel.operators.keywords import keyword_labels
from seedlabel.operators.sentences import split_sentences
from seedlabel.plans import text_queries as TQ
from seedlabel.plans.vocab_queries import FILTER_WORDS, K1, M, _PUNCT, _SEEDS
from seedlabel.session import checkpoint_dir, load_table, spread, written_table

# Fixed query parameters.
NETWORK = dict(hidden=16, iters=8, step=1.0)


def turn_sentences(spark, sf_dir) -> DataFrame:
    """``(conv_id, turn, pos, tokens)`` of every sentence of every turn."""
    turns = spread(load_table(spark, sf_dir, "conversations"))
    s = split_sentences(turns, "conv_id", "text", keep=["turn"])
    return s.select("conv_id", "turn", "pos", tokens("sentence").alias("tokens"))


def _positions(spark, sf_dir) -> DataFrame:
    return V.token_positions(turn_sentences(spark, sf_dir), ["conv_id"])


def q_backoff_substitutes(spark, sf_dir):
    """The 10 likeliest words of every context, seen there or not."""
    return B.backoff_substitutes(_positions(spark, sf_dir), K1)


def q_backoff_vocabulary(spark, sf_dir):
    """Class vocabularies whose substitutes come from the back-off model: every
    seed occurrence counts each of its 10 likeliest words."""
    model = B.BackoffModel(_positions(spark, sf_dir))
    seeds = V.seed_table(spark, TQ.LANG_SEEDS)
    at_seeds = (model.exact.join(F.broadcast(seeds), "word").groupBy("left", "right", "cls").agg(F.sum("n").alias("occ")))
    contexts = model.contexts().join(at_seeds.select("left", "right").distinct(), ["left", "right"], "left_semi")
    subs = model.top(contexts, K1).filter(V._usable("word", FILTER_WORDS))
    vocab = (at_seeds.join(subs, ["left", "right"]).groupBy("cls", "word").agg(F.sum("occ").alias("freq")))
    return V.disjoint_vocabulary(vocab, M)


def q_word_class_tags(spark, sf_dir):
    """Every word's most frequent class under a hidden Markov model (trained, so without a SQL twin)."""
    sent = written_table(turn_sentences(spark, sf_dir).select("tokens"), "turn-sentences")
    return H.word_tags(H.tag_counts(sent, *H.fit(sent)))


def q_keyword_network_report(spark, sf_dir):
    """Lines labelled by keywords train a network with one hidden layer; every
    line is evaluated against the language of its document."""
    lines = written_table(TQ.keyword_lines(spark, sf_dir).select("gold", "tokens"), "lines")  # tokenised once
    labelled = keyword_labels(lines, "tokens", TQ.LANG_SEEDS)
    net = N.train(N.hashed_features(labelled, "tokens", ["label"]), "label", len(TQ.LANGS), **NETWORK)
    pred = N.predict(N.hashed_features(lines, "tokens", ["gold"]), net, ["gold"])
    return metrics.classification_report(pred, "gold", "pred")


def q_word_weights(spark, sf_dir):
    """Inverse-frequency weight of every word of ``documents``."""
    w = E.word_weights(TQ.sentences(spark, sf_dir).select(tokens("sentence").alias("tokens")))
    return w.select("word", "n", F.round("weight", 9).alias("weight"))


def q_cached_sentence_embeddings(spark, sf_dir):
    """Embeddings of every sentence of every turn through the cache table: the
    users' turns fill it, then all turns read it and add what is missing; the
    direction that all share is removed."""
    sent = written_table(turn_sentences(spark, sf_dir)
                         .join(load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"),
                               ["conv_id", "turn"]), "turn-sentences")
    texts = sent.select("conv_id", "turn", "pos", "role", F.array_join("tokens", " ").alias("text"))
    encode = E.encoder(E.head_weights(E.word_weights(sent)))
    cache = f"{checkpoint_dir(spark).rstrip('/')}/embedding-cache-{uuid.uuid4().hex}"
    EC.embed_with_cache(spark, texts.filter("role = 'user'"), encode, cache, "hashed")
    full = EC.embed_with_cache(spark, texts, encode, cache, "hashed")
    rows = written_table(full.select("conv_id", "turn", "pos", "embedding"), "embeddings")
    return E.without_direction(rows, E.first_direction(rows))


# ---------------------------------------------------------------------------
# SQL twins (DuckDB)


def _network_sql() -> str:
    """One CTE chain per gradient step: forward, back-propagation, momentum."""
    d, h, k, step, mom = N.DIMS, NETWORK["hidden"], len(TQ.LANGS), NETWORK["step"], N.MOMENTUM
    bucket = f"('0x' || substr(md5({{}}), 1, 8))::BIGINT"
    start = f"({bucket.format(chr(39) + '{0}:' + chr(39) + ' || {1} || ' + chr(39) + ':' + chr(39) + ' || {2}')}" \
        f" / 4294967296.0::DOUBLE * 2 - 1)"

    def forward(x: str, n: str, i: int) -> str:
        return f"""
a{n} AS MATERIALIZED (SELECT id, y, h, tanh(sum(v * w)) AS a FROM {x} JOIN u{i} USING (d) GROUP BY id, y, h
        UNION ALL SELECT DISTINCT id, y, -1, 1.0::DOUBLE FROM {x}),
z{n} AS MATERIALIZED (SELECT id, y, k, sum(a * w) AS z FROM a{n} JOIN o{i} USING (h) GROUP BY id, y, k)"""

    ctes = [TQ.KEYWORD_CTE, f"""
kx AS MATERIALIZED (SELECT row_number() OVER () AS id, kt.gold, t, m FROM kt JOIN km USING (doc_id, line_no)),
tk AS (SELECT id, unnest(t) AS w FROM kx),
ft AS MATERIALIZED (
    SELECT b.id, CAST(b.d AS INTEGER) AS d, b.c / CAST(n.c AS DOUBLE) AS v
    FROM (SELECT id, {bucket.format('w')} % {d} AS d, count(*) AS c FROM tk GROUP BY ALL) b
    JOIN (SELECT id, count(*) AS c FROM tk GROUP BY id) n USING (id)
    UNION ALL SELECT id, -1, 1.0 FROM kx),
x AS MATERIALIZED (SELECT ft.id, CAST(m[1] AS INTEGER) AS y, d, v FROM ft JOIN kx USING (id) WHERE len(m) = 1),
nn AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM x WHERE d = -1),
u0 AS MATERIALIZED (SELECT CAST(h AS INTEGER) AS h, CAST(d AS INTEGER) AS d, CASE WHEN d < 0 THEN 0.0 ELSE
        {start.format('hidden', 'h', 'd')} END AS w, 0.0::DOUBLE AS vel FROM range({h}) a(h), range(-1, {d}) b(d)),
o0 AS MATERIALIZED (SELECT CAST(k AS INTEGER) AS k, CAST(h AS INTEGER) AS h, CASE WHEN h < 0 THEN 0.0 ELSE
        {start.format('out', 'k', 'h')} END AS w, 0.0::DOUBLE AS vel FROM range({k}) a(k), range(-1, {h}) b(h))"""]
    for i in range(NETWORK["iters"]):
        ctes.append(forward("x", str(i), i) + f""",
g{i} AS MATERIALIZED (SELECT id, k, e / sum(e) OVER (PARTITION BY id) - CASE WHEN k = y THEN 1 ELSE 0 END AS g
      FROM (SELECT id, y, k, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM z{i})),
o{i + 1} AS MATERIALIZED (SELECT k, h, w + nv AS w, nv AS vel FROM (
    SELECT k, h, w, {mom}::DOUBLE * vel - {step}::DOUBLE * s / (SELECT n FROM nn) AS nv
    FROM o{i} JOIN (SELECT k, h, sum(g * a) AS s FROM g{i} JOIN a{i} USING (id) GROUP BY k, h) USING (k, h))),
b{i} AS MATERIALIZED (SELECT id, a{i}.h, q.s * (1 - a * a) AS g FROM a{i} JOIN (
    SELECT id, h, sum(g * w) AS s FROM g{i} JOIN o{i} USING (k) WHERE h >= 0 GROUP BY id, h) q USING (id, h)),
u{i + 1} AS MATERIALIZED (SELECT h, d, w + nv AS w, nv AS vel FROM (
    SELECT h, d, w, {mom}::DOUBLE * vel - {step}::DOUBLE * coalesce(s, 0) / (SELECT n FROM nn) AS nv
    FROM u{i} LEFT JOIN (SELECT h, d, sum(g * v) AS s FROM b{i} JOIN x USING (id) GROUP BY h, d) USING (h, d)))""")
    last = NETWORK["iters"]
    ctes.append("fa AS (SELECT id, gold AS y, d, v FROM ft JOIN kx USING (id))," + forward("fa", "f", last) + """,
pn AS (SELECT y AS gold, k AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY z DESC, k) AS rn FROM zf) WHERE rn = 1)""")
    return "WITH " + ",".join(ctes) + "," + TQ._report_sql("pn")


_TURNS = "(SELECT conv_id * 100000 + turn AS doc_id, 'x' AS lang, text FROM conversations)"

_BACKOFF_CTE = "WITH " + TQ.SENTENCES_CTE.replace("FROM documents", f"FROM {_TURNS}") + rf""",
st AS (SELECT list_concat(['<s>'], list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> ''), ['</s>']) AS p
       FROM sents),
fc AS MATERIALIZED (SELECT l, r, w, count(*) AS n FROM (
        SELECT p[i] AS l, p[i + 1] AS w, p[i + 2] AS r FROM (SELECT p, unnest(range(1, len(p) - 1)) AS i FROM st)) GROUP BY ALL),
lw AS MATERIALIZED (SELECT l, w, sum(n) AS n FROM fc GROUP BY l, w),
rw AS MATERIALIZED (SELECT r, w, sum(n) AS n FROM fc GROUP BY r, w),
kd AS (SELECT w, count(*) AS k FROM (SELECT w FROM lw UNION ALL SELECT w FROM rw) GROUP BY w),
ct AS MATERIALIZED (SELECT w, CAST(k AS DOUBLE) / (SELECT sum(k) FROM kd) AS c FROM kd),
ex AS MATERIALIZED (SELECT l, r, w, (n - {B.DISCOUNT}::DOUBLE) / t AS x FROM (
        SELECT *, sum(n) OVER (PARTITION BY l, r) AS t, row_number() OVER (PARTITION BY l, r ORDER BY n DESC, w) AS k FROM fc)
       WHERE k <= {B.ENTRIES}),
el AS MATERIALIZED (SELECT l, w, (n - {B.DISCOUNT}::DOUBLE) / t AS x FROM (
        SELECT *, sum(n) OVER (PARTITION BY l) AS t, row_number() OVER (PARTITION BY l ORDER BY n DESC, w) AS k FROM lw)
       WHERE k <= {B.ENTRIES}),
er AS MATERIALIZED (SELECT r, w, (n - {B.DISCOUNT}::DOUBLE) / t AS x FROM (
        SELECT *, sum(n) OVER (PARTITION BY r) AS t, row_number() OVER (PARTITION BY r ORDER BY n DESC, w) AS k FROM rw)
       WHERE k <= {B.ENTRIES}),
mx AS (SELECT l, r, 1.0::DOUBLE - sum(x) AS m FROM ex GROUP BY l, r),
ml AS (SELECT l, 1.0::DOUBLE - sum(x) AS m FROM el GROUP BY l),
mr AS (SELECT r, 1.0::DOUBLE - sum(x) AS m FROM er GROUP BY r),
cm AS (SELECT w FROM ct ORDER BY c DESC, w LIMIT {K1 + 3 * B.ENTRIES}),
cd AS (SELECT l, r, w, x FROM ex
       UNION ALL SELECT mx.l, mx.r, el.w, mx.m / 2 * el.x FROM mx JOIN el ON el.l = mx.l
       UNION ALL SELECT mx.l, mx.r, er.w, mx.m / 2 * er.x FROM mx JOIN er ON er.r = mx.r
       UNION ALL SELECT mx.l, mx.r, cm.w, 0.0::DOUBLE FROM mx CROSS JOIN cm),
pr AS (SELECT g.l, g.r, g.w, round(g.x + mx.m / 2 * (ml.m + mr.m) * ct.c, {B.PLACES}) AS p
       FROM (SELECT l, r, w, sum(x) AS x FROM cd GROUP BY l, r, w) g JOIN mx ON mx.l = g.l AND mx.r = g.r
       JOIN ml ON ml.l = g.l JOIN mr ON mr.r = g.r JOIN ct ON ct.w = g.w),
tp AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l, r ORDER BY p DESC, w) AS INTEGER) AS rank FROM pr)
       WHERE rank <= {K1})"""

QUERIES = {
    "backoff_substitutes": q_backoff_substitutes,
    "backoff_vocabulary": q_backoff_vocabulary,
    "word_class_tags": q_word_class_tags,
    "word_weights": q_word_weights,
    "cached_sentence_embeddings": q_cached_sentence_embeddings,
    "keyword_network_report": q_keyword_network_report,
}
ORACLE = {
    "word_weights": "WITH " + TQ.SENTENCES_CTE + rf""",
w AS (SELECT unnest(list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> '')) AS word FROM sents),
c AS (SELECT word, count(*) AS n FROM w GROUP BY word)
SELECT word, n, round({E.A!r}::DOUBLE / ({E.A!r}::DOUBLE + CAST(n AS DOUBLE) / (SELECT sum(n) FROM c)), 9) AS weight FROM c""",
    "keyword_network_report": _network_sql(),
    "backoff_substitutes": _BACKOFF_CTE + '\nSELECT l AS "left", r AS "right", w AS word, p, rank FROM tp',
    "backoff_vocabulary": _BACKOFF_CTE + f""",
seeds(cls, word) AS (VALUES {_SEEDS}),
oc AS (SELECT l, r, cls, sum(n) AS occ FROM fc JOIN seeds ON fc.w = seeds.word GROUP BY ALL),
vo AS (SELECT CAST(cls AS INTEGER) AS cls, tp.w AS word, CAST(sum(occ) AS BIGINT) AS freq FROM oc JOIN tp USING (l, r)
       WHERE NOT list_contains({_PUNCT}, tp.w) AND NOT contains(tp.w, '##') GROUP BY ALL),
kp AS (SELECT cls, word, freq FROM (SELECT *, max(freq) OVER (PARTITION BY word) AS mx FROM vo) WHERE freq = mx)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cls ORDER BY freq DESC, word DESC) AS INTEGER) AS rank
               FROM kp) WHERE rank <= {M}""",
}
