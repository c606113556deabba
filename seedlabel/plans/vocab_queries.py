"""Vocabulary labeler queries on the sentences of ``documents``.

Classes and seeds are the language classes of :mod:`text_queries`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.functions.text import PUNCTUATION
from seedlabel.operators import contexts as X, metrics, vocabulary as V
from seedlabel.operators.keywords import encode_labels
from seedlabel.operators.packed import pack_texts
from seedlabel.plans import text_queries as TQ
from seedlabel.session import NO_SHUFFLES_LEFT, emptied, settings, written_table

# Fixed query parameters.
K1 = 10          # substitutes per seed occurrence when building vocabularies
K2 = 30          # substitutes per token when scoring
M = 100          # vocabulary size per class
LAMBDA = 0.5     # z-score threshold
NOUN_LETTERS = 6 # words of this length or more are tagged NOUN
FILTER_WORDS = PUNCTUATION
N_CLASSES = len(TQ.LANGS)
BLOCK_TOKENS = 1 << 20  # two tasks of an executor hold a block's contexts each


class VocabRun:
    """One vocabulary-labeler run on the packed sentences of ``documents``."""

    def __init__(self, spark, sf_dir):
        self.spark = spark
        docs = TQ.documents(spark, sf_dir).select("doc_id", encode_labels("lang", TQ.LANGS).alias("gold"), "text")
        # split once: every pass reads the packed sentences
        self.sent = pack_texts(docs, ["doc_id", "gold"], block_tokens=BLOCK_TOKENS)
        self.contexts = X.contexts(self.sent)

    def subs(self, k):
        return X.substitutes(self.contexts, k)

    def vocab(self, contexts=None):
        return X.class_vocabulary(contexts or self.contexts, V.seed_table(self.spark, TQ.LANG_SEEDS), K1, FILTER_WORDS)

    def disjoint(self):
        return V.disjoint_vocabulary(self.vocab(), M)

    def scores(self, lexicon=None):
        kept = self.contexts.written()  # the vocabulary and the hits ask the same buckets, and nothing else does
        with settings(self.spark, NO_SHUFFLES_LEFT):
            vocab = V.disjoint_vocabulary(self.vocab(kept), M)
            hits = written_table(X.class_hits(kept, vocab, K2, FILTER_WORDS, N_CLASSES), "context-hits")
        emptied(self.spark, kept.path)
        return X.overlap_scores(self.contexts, ["doc_id", "pos"], hits, N_CLASSES, FILTER_WORDS, lexicon=lexicon,
                                carry=["gold"])

    def z(self):
        # the scores feed both the class statistics and the standardisation
        s = written_table(self.scores(), "overlap-scores")
        return V.zscores(s, V.class_score_stats(s, n_classes=N_CLASSES), n_classes=N_CLASSES)


def q_substitute_topk(spark, sf_dir):
    return VocabRun(spark, sf_dir).subs(K1)


def q_class_vocabulary(spark, sf_dir):
    return VocabRun(spark, sf_dir).vocab()


def q_disjoint_vocabulary(spark, sf_dir):
    return VocabRun(spark, sf_dir).disjoint()


def q_overlap_scores(spark, sf_dir):
    s = VocabRun(spark, sf_dir).scores()
    return (s.select("doc_id", "pos", F.posexplode("scores").alias("cls", "score"))
            .filter(F.col("score") > 0)
            .select("doc_id", "pos", F.col("cls").cast("int"), F.round("score", 6).alias("score")))


def word_tags(words: DataFrame) -> DataFrame:
    """A stand-in for a tagger's table: every word with a tag by its length."""
    words = words.select("word").distinct()
    return words.select("word", F.when(F.length("word") >= NOUN_LETTERS, "NOUN").otherwise("OTHER").alias("tag"))


def q_tagged_overlap_scores(spark, sf_dir):
    """Overlap scores over the candidate words of a word-tag table."""
    run = VocabRun(spark, sf_dir)
    s = run.scores(V.tagged_lexicon(word_tags(run.sent.words()), ["NOUN"]))
    return (s.select("doc_id", "pos", F.posexplode("scores").alias("cls", "score")).filter(F.col("score") > 0)
            .select("doc_id", "pos", F.col("cls").cast("int"), F.round("score", 6).alias("score")))


def q_class_score_stats(spark, sf_dir):
    st = V.class_score_stats(VocabRun(spark, sf_dir).scores(), n_classes=N_CLASSES)
    return st.select("cls", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def q_zscore_labels(spark, sf_dir):
    z = V.zscore_labels(VocabRun(spark, sf_dir).z(), LAMBDA, n_classes=N_CLASSES)
    return z.select("doc_id", "pos", "label", F.round(F.col("z")[F.col("label")], 6).alias("z"))


def _forced(spark, sf_dir) -> DataFrame:
    r = VocabRun(spark, sf_dir)
    return V.zscore_forced(r.z())


def q_zscore_forced(spark, sf_dir):
    return _forced(spark, sf_dir).select("doc_id", "pos", "label", F.round("z_best", 6).alias("z"))


def q_zscore_report(spark, sf_dir):
    return metrics.classification_report(_forced(spark, sf_dir), "gold", "label")


# ---------------------------------------------------------------------------
# Oracle SQL (DuckDB)

def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_PUNCT = _sql_list(FILTER_WORDS)
_USABLE = f"NOT list_contains({_PUNCT}, word) AND NOT contains(word, '##')"
_SEEDS = ", ".join(f"({i}, '{w}')" for i, seeds in enumerate(TQ.LANG_SEEDS) for w in dict.fromkeys(seeds))

VOCAB_CTE = TQ.SENTENCES_CTE + rf""",
st AS (SELECT doc_id, pos, CAST({TQ._lang_code('lang')} AS INTEGER) AS gold,
              list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> '') AS t FROM sents),
pp AS (SELECT doc_id, pos, list_concat(['<s>'], t, ['</s>']) AS p, unnest(range(1, len(t) + 1)) AS i FROM st),
P AS (SELECT doc_id, pos, p[i] AS "left", p[i + 1] AS token, p[i + 2] AS "right" FROM pp),
F AS (SELECT "left", "right", token AS word, count(*) AS n FROM P GROUP BY ALL),
R AS (SELECT *, CAST(row_number() OVER (PARTITION BY "left", "right" ORDER BY n DESC, word ASC) AS INTEGER) AS rank
      FROM F),
S1 AS (SELECT * FROM R WHERE rank <= {K1}),
S2 AS (SELECT * FROM R WHERE rank <= {K2}),
seeds(cls, word) AS (VALUES {_SEEDS}),
occ AS (SELECT s.cls, P."left", P."right", count(*) AS occ FROM P JOIN seeds s ON P.token = s.word GROUP BY ALL),
vocab AS (SELECT CAST(occ.cls AS INTEGER) AS cls, S1.word, CAST(sum(occ.occ) AS BIGINT) AS freq
          FROM occ JOIN S1 USING ("left", "right") WHERE {_USABLE.replace('word', 'S1.word')} GROUP BY ALL),
kept AS (SELECT cls, word, freq FROM (SELECT *, max(freq) OVER (PARTITION BY word) AS mx FROM vocab) WHERE freq = mx),
dv AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cls ORDER BY freq DESC, word DESC) AS INTEGER)
       AS rank FROM kept) WHERE rank <= {M}),
fst AS (SELECT word, min(cls) AS cls FROM dv GROUP BY word),
hits AS (SELECT "left", "right", cls, count(*) AS hits FROM S2 JOIN fst USING (word) WHERE {_USABLE.replace('word', 'S2.word')}
         GROUP BY ALL),
nc AS (SELECT doc_id, pos, gold, len(list_filter(t, lambda x: NOT list_contains({_PUNCT}, x))) AS n_cand FROM st),
H AS (SELECT doc_id, pos, cls, sum(hits) AS h FROM P JOIN hits USING ("left", "right")
      WHERE NOT list_contains({_PUNCT}, token) GROUP BY ALL),
classes AS (SELECT unnest(range({N_CLASSES})) AS cls),
dense AS (SELECT nc.doc_id, nc.pos, nc.gold, CAST(c.cls AS INTEGER) AS cls,
                 coalesce(H.h, 0) / greatest(nc.n_cand, 1) AS score
          FROM nc CROSS JOIN classes c LEFT JOIN H ON H.doc_id = nc.doc_id AND H.pos = nc.pos AND H.cls = c.cls),
stats AS (SELECT cls, avg(score) AS mean, stddev_pop(score) AS sd FROM dense GROUP BY cls),
Z AS (SELECT d.*, CASE WHEN s.sd = 0 THEN NULL ELSE (d.score - s.mean) / s.sd END AS z
      FROM dense d JOIN stats s USING (cls))"""


def _w(body: str) -> str:
    return "WITH " + VOCAB_CTE + "\n" + body


_FORCED = """
forced AS (SELECT doc_id, pos, gold, cls AS label, z FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY z DESC, cls) AS rn FROM Z
    WHERE z IS NOT NULL AND z > -100) WHERE rn = 1)"""

QUERIES = {
    "substitute_topk": q_substitute_topk,
    "class_vocabulary": q_class_vocabulary,
    "disjoint_vocabulary": q_disjoint_vocabulary,
    "overlap_scores": q_overlap_scores,
    "tagged_overlap_scores": q_tagged_overlap_scores,
    "class_score_stats": q_class_score_stats,
    "zscore_labels": q_zscore_labels,
    "zscore_forced": q_zscore_forced,
    "zscore_report": q_zscore_report,
}

ORACLE = {
    "substitute_topk": _w('SELECT "left", "right", word, n, rank FROM S1'),
    "class_vocabulary": _w("SELECT cls, word, freq FROM vocab"),
    "disjoint_vocabulary": _w("SELECT cls, word, freq, rank FROM dv"),
    "overlap_scores": _w("SELECT doc_id, pos, cls, round(score, 6) AS score FROM dense WHERE score > 0"),
    "tagged_overlap_scores": "WITH " + VOCAB_CTE.replace(
        f"len(list_filter(t, lambda x: NOT list_contains({_PUNCT}, x)))",
        f"len(list_filter(t, lambda x: NOT list_contains({_PUNCT}, x) AND length(x) >= {NOUN_LETTERS}))").replace(
        f"WHERE NOT list_contains({_PUNCT}, token)",
        f"WHERE NOT list_contains({_PUNCT}, token) AND length(token) >= {NOUN_LETTERS}")
        + "\nSELECT doc_id, pos, cls, round(score, 6) AS score FROM dense WHERE score > 0",
    "class_score_stats": _w("SELECT CAST(cls AS INTEGER) AS cls, round(mean, 6) AS mean, round(sd, 6) AS sd FROM stats"),
    "zscore_labels": _w(f"""
SELECT doc_id, pos, cls AS label, round(z, 6) AS z FROM (
    SELECT *, count(*) FILTER (WHERE z >= {LAMBDA}) OVER (PARTITION BY doc_id, pos) AS k FROM Z)
WHERE k = 1 AND z >= {LAMBDA}"""),
    "zscore_forced": "WITH " + VOCAB_CTE + "," + _FORCED + "\nSELECT doc_id, pos, label, round(z, 6) AS z FROM forced",
    "zscore_report": "WITH " + VOCAB_CTE + "," + _FORCED + "," + TQ._report_sql("forced"),
}
