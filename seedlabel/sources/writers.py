"""Writers (sinks).  Parquet is the storage format; the reference's text
layouts are export/import formats only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.operators.keywords import decode_labels
from seedlabel.operators.splits import global_index
from seedlabel.session import read_if_present


def write_labels(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def export_label_text(df: DataFrame, path: str, aspects: list[str], polarities: list[str],
                      order_col: str | None = None) -> None:
    """Two lines per record: sentence, then ``aspect polarity`` names."""
    rec = F.concat_ws("\n", F.col("sentence"),
                      F.concat_ws(" ", decode_labels("aspect", aspects), decode_labels("polarity", polarities)))
    out = df.orderBy(order_col) if order_col else df
    out.select(rec.alias("value")).write.mode("overwrite").text(path)


def export_score_text(scores: DataFrame, path: str, class_names: list[str], order_col: str | None = None) -> None:
    """Sentence line, then `` name: value`` for every class (``scores`` array)."""
    pairs = F.array(*[F.concat(F.lit(f" {n}: "), F.col("scores")[i].cast("string")) for i, n in enumerate(class_names)])
    rec = F.concat_ws("\n", F.col("sentence"), F.array_join(pairs, ""))
    out = scores.orderBy(order_col) if order_col else scores
    out.select(rec.alias("value")).write.mode("overwrite").text(path)


def write_vocabularies(vocab: DataFrame, path: str, class_names: list[str]) -> None:
    """One folder per class with ``word freq`` lines, highest frequency first;
    a large class spans several files, in order."""
    v = vocab.withColumn("class_name", decode_labels("cls", class_names))
    order = [F.col("class_name"), F.desc("freq"), F.desc("word")]
    (v.repartitionByRange(*order).sortWithinPartitions(*order)
     .select("class_name", F.concat_ws(" ", "word", F.col("freq").cast("string")).alias("value"))
     .write.mode("overwrite").partitionBy("class_name").text(path))


def write_predictions_csv(pred: DataFrame, path: str) -> None:
    pred.write.mode("overwrite").option("header", "true").csv(path)


def write_run_json(reports: DataFrame, path: str) -> None:
    """All report rows of one run as JSON lines."""
    reports.select(F.to_json(F.struct(*reports.columns)).alias("value")).write.mode("overwrite").text(path)


def run_result_rows(summary: DataFrame, ablation: str, domain: str | None, ts_col=None) -> DataFrame:
    """Result rows ``(timestamp, type, ablation, domain, accuracy, precision,
    recall, f1_score)`` from a report summary with a ``kind`` column."""
    ts = ts_col if ts_col is not None else F.current_timestamp()
    return summary.select(ts.alias("timestamp"), F.col("kind").alias("type"), F.lit(ablation).alias("ablation"),
                          F.lit(domain).cast("string").alias("domain"), "accuracy", "precision", "recall", "f1_score")


def append_results(rows: DataFrame, path: str) -> None:
    """Append-only result table (no read-modify-write of older runs)."""
    rows.write.mode("append").parquet(path)


def run_stamp(ts_col) -> F.Column:
    """``yyyyMMdd_HHmmss`` text of a timestamp (and back with :func:`parse_stamp`)."""
    return F.date_format(ts_col, "yyyyMMdd_HHmmss")


def parse_stamp(col) -> F.Column:
    return F.to_timestamp(col, "yyyyMMdd_HHmmss")


def write_corpus_splits(docs: DataFrame, splits: DataFrame, key: str, path: str, text_col: str = "text") -> None:
    docs.join(splits, key).select("split", text_col).write.mode("overwrite").partitionBy("split").text(path)


def write_gold_tsv(gold: DataFrame, path: str, order_cols: list[str]) -> None:
    """``index \\t aspect \\t polarity \\t sentence``; index = 0-based row position.
    The ranged partitions are written as they are, in order."""
    g = global_index(gold, order_cols, "index")
    (g.select("index", "aspect", "polarity", "sentence")
     .write.mode("overwrite").option("sep", "\t").option("quote", "").option("header", "false").csv(path))


def append_trials(trials: DataFrame, path: str) -> None:
    trials.write.mode("append").parquet(path)


def pending_trials(spark, candidates: DataFrame, path: str, param_cols: list[str]) -> DataFrame:
    """Resume: the candidate parameter rows not yet present in the trial table."""
    done = read_if_present(spark, path)
    if done is None:  # no trial table yet
        return candidates
    done = done.select(*param_cols)
    return candidates.join(done, param_cols, "left_anti")
