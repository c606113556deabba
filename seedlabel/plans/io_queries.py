"""Round trips through the file formats, and expressions of the result tables,
on the given tables: each query writes to the shared checkpoint folder, reads
back through the library's reader and returns what it read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.functions.decode import decode_bytes_literal
from seedlabel.functions.text import word_tokens_joined
from seedlabel.operators import metrics
from seedlabel.operators.keywords import encode_labels
from seedlabel.plans import text_queries as TQ
from seedlabel.plans.tabular_queries import ORACLE as TABULAR_ORACLE
from seedlabel.plans.tabular_queries import q_corpus_split
from seedlabel.session import checkpoint_dir, load_table
from seedlabel.sources import readers, writers
from seedlabel.streaming.scorer import run_to_table, stream_table, windowed_label_counts

POLARITIES = ["negative", "positive"]
WINDOW, WATERMARK = "6 hours", "1 hour"


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _labelled(spark, sf_dir) -> DataFrame:
    """Sentences with their language as aspect and the parity of their position as polarity."""
    s = TQ.sentences(spark, sf_dir).filter(F.col("sentence") != "")
    return s.select("doc_id", "pos", F.translate("sentence", "\t\r", "  ").alias("sentence"),
                    encode_labels("lang", TQ.LANGS).alias("aspect"), (F.col("pos") % 2).cast("int").alias("polarity"))


def q_label_file_roundtrip(spark, sf_dir):
    path = _folder(spark, "labels")
    writers.export_label_text(_labelled(spark, sf_dir), path, TQ.LANGS, POLARITIES)
    back = readers.read_label_file(spark, path, TQ.LANGS, POLARITIES)
    return back.groupBy("sentence", "aspect", "polarity").agg(F.count(F.lit(1)).alias("n"))


def q_score_file_roundtrip(spark, sf_dir):
    path = _folder(spark, "scores")
    s = _labelled(spark, sf_dir)
    halves = F.array(*[(F.col("pos") + c).cast("double") / 2 for c in range(len(TQ.LANGS))])
    writers.export_score_text(s.withColumn("scores", halves), path, TQ.LANGS)
    return readers.read_score_file(spark, path).groupBy("class_name", "score").agg(F.count(F.lit(1)).alias("n"))


def q_gold_tsv_whole_roundtrip(spark, sf_dir):
    path = _folder(spark, "gold")
    writers.write_gold_tsv(_labelled(spark, sf_dir), path, ["doc_id", "pos"])
    return readers.read_gold_tsv(spark, path)


def _words(spark, sf_dir) -> DataFrame:
    return _labelled(spark, sf_dir).select(F.col("aspect").alias("cls"), F.explode(F.split("sentence", " ")).alias("word"))


def q_vocabulary_whole_roundtrip(spark, sf_dir):
    path = _folder(spark, "vocabulary")
    counts = _words(spark, sf_dir).groupBy("cls", "word").agg(F.count(F.lit(1)).alias("freq"))
    writers.write_vocabularies(counts, path, TQ.LANGS)
    parts = F.split("value", " ")
    return spark.read.text(path).select("class_name", parts[0].alias("word"), parts[1].cast("long").alias("freq"))


def q_prediction_file_report(spark, sf_dir):
    """Predictions written as CSV with a header and read back; the gold labels
    joined to them by sentence; the classification report of the pairs."""
    path = _folder(spark, "predictions")
    scored = TQ.one_step_scored(spark, sf_dir)
    writers.write_predictions_csv(scored.select("doc_id", "pos", "label", "score"), path)
    pred = spark.read.schema("doc_id long, pos int, label int, score double").option("header", "true").csv(path)
    gold = TQ.sentences(spark, sf_dir).select("doc_id", "pos", encode_labels("lang", TQ.LANGS).alias("gold"))
    return metrics.classification_report(gold.join(pred, ["doc_id", "pos"]), "gold", "label")


def q_split_file_lines(spark, sf_dir):
    """The corpus split files, written as text and read back: lines and characters of each split."""
    path = _folder(spark, "splits")
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    splits = q_corpus_split(spark, sf_dir).select("doc_id", "split")
    writers.write_corpus_splits(docs, splits, "doc_id", path)
    back = spark.read.option("lineSep", "\n").text(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("chars"))


def q_results_roundtrip(spark, sf_dir):
    """Two runs appended to one result table; stamps as text and back."""
    path = _folder(spark, "results")
    o = load_table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(
        F.count(F.lit(1)).cast("double").alias("accuracy"), F.min("o_orderkey").cast("double").alias("precision"),
        F.max("o_orderkey").cast("double").alias("recall"), F.lit(0.5).alias("f1_score"))
    for day in ("20240102_030405", "20250607_080910"):
        stamp = writers.parse_stamp(F.lit(day))
        writers.append_results(writers.run_result_rows(o, "none", "orders", stamp), path)
    return spark.read.parquet(path).select(writers.run_stamp(F.col("timestamp")).alias("stamp"), "type", "ablation",
                                           "domain", "accuracy", "precision", "recall", "f1_score")


def q_run_json_roundtrip(spark, sf_dir):
    path = _folder(spark, "json")
    counts = load_table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"))
    writers.write_run_json(counts, path)
    return spark.read.schema("l_returnflag string, l_linestatus string, n long").json(path)


def q_bytes_literal_text(spark, sf_dir):
    """Texts kept as bytes literals, decoded, lower-cased and word-tokenised."""
    p = load_table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("b'"), "p_name", F.lit(".'")).alias("raw"))
    return p.select("p_partkey", word_tokens_joined(decode_bytes_literal("raw")).alias("text"))


def q_stream_event_windows(spark, sf_dir):
    """Closed event-time windows of the event stream with their counts; all
    files in one micro-batch, so that their order makes no row late."""
    agg = windowed_label_counts(stream_table(spark, sf_dir, "events", max_files=None), "ts", "event_type", WINDOW, WATERMARK)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return spark.read.parquet(run_to_table(agg, spark, "append")).select(
        stamp("window_start"), stamp("window_end"), "event_type", "n")


_LABELLED = "WITH " + TQ.SENTENCES_CTE + f""",
lab AS (SELECT doc_id, pos, translate(sentence, chr(9) || chr(13), '  ') AS sentence,
        CAST(list_position({TQ.LANGS!r}, lang) - 1 AS INTEGER) AS aspect, CAST(pos % 2 AS INTEGER) AS polarity
        FROM sents WHERE sentence <> '')"""

QUERIES = {
    "label_file_roundtrip": q_label_file_roundtrip,
    "score_file_roundtrip": q_score_file_roundtrip,
    "gold_tsv_whole_roundtrip": q_gold_tsv_whole_roundtrip,
    "vocabulary_whole_roundtrip": q_vocabulary_whole_roundtrip,
    "prediction_file_report": q_prediction_file_report,
    "split_file_lines": q_split_file_lines,
    "results_roundtrip": q_results_roundtrip,
    "run_json_roundtrip": q_run_json_roundtrip,
    "bytes_literal_text": q_bytes_literal_text,
    "stream_event_windows": q_stream_event_windows,
}

ORACLE = {
    "label_file_roundtrip": _LABELLED + "\nSELECT sentence, aspect, polarity, count(*) AS n FROM lab GROUP BY ALL",
    "score_file_roundtrip": _LABELLED + f"""
SELECT {TQ.LANGS!r}[i + 1] AS class_name, CAST(pos + i AS DOUBLE) / 2 AS score, count(*) AS n
FROM lab, range({len(TQ.LANGS)}) r(i) GROUP BY ALL""",
    "gold_tsv_whole_roundtrip": _LABELLED + """
SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS id, aspect, polarity, sentence FROM lab""",
    "vocabulary_whole_roundtrip": _LABELLED + f""",
w AS (SELECT aspect, unnest(string_split(sentence, ' ')) AS word FROM lab)
SELECT {TQ.LANGS!r}[aspect + 1] AS class_name, word, count(*) AS freq FROM w GROUP BY ALL""",
    "prediction_file_report": TQ.ORACLE["one_step_report"],
    "split_file_lines": f"""
WITH s AS ({TABULAR_ORACLE["corpus_split"]})
SELECT split, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines,
       CAST(sum(length(replace(text, chr(10), ''))) AS BIGINT) AS chars
FROM documents JOIN s USING (doc_id) GROUP BY split""",
    "results_roundtrip": """
SELECT stamp, o_orderstatus AS type, 'none' AS ablation, 'orders' AS domain, CAST(count(*) AS DOUBLE) AS accuracy,
       CAST(min(o_orderkey) AS DOUBLE) AS precision, CAST(max(o_orderkey) AS DOUBLE) AS recall,
       CAST(0.5 AS DOUBLE) AS f1_score
FROM orders, (VALUES ('20240102_030405'), ('20250607_080910')) v(stamp) GROUP BY stamp, o_orderstatus""",
    "run_json_roundtrip": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL",
    "bytes_literal_text": "SELECT p_partkey, lower(p_name) || ' .' AS text FROM part",
    "stream_event_windows": f"""
WITH w AS (SELECT time_bucket(INTERVAL '{WINDOW}', ts, TIMESTAMP '1970-01-01') AS window_start, event_type FROM events)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(window_start + INTERVAL '{WINDOW}', '%Y-%m-%d %H:%M:%S') AS window_end, event_type, count(*) AS n FROM w
WHERE window_start + INTERVAL '{WINDOW}' <= (SELECT max(ts) FROM events) - INTERVAL '{WATERMARK}'
GROUP BY ALL""",
}
