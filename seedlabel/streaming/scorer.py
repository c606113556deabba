"""Streaming scoring of new text.

The per-row work (split, tokenise, keyword / prototype scoring) is the same
stateless expression code as in batch; the only state is the running count
per label, kept in the state store.  Results go through ``foreachBatch`` to
a table in the shared checkpoint folder, so a restarted query resumes from
its checkpoint; a replayed micro-batch overwrites its own earlier rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedlabel.functions.text import tokens
from seedlabel.operators.keywords import keyword_labels
from seedlabel.operators.sentences import split_lines
from seedlabel.session import checkpoint_dir


def stream_table(spark: SparkSession, folder: str, name: str, max_files: int | None = 1,
                 spread_rows: bool = False) -> DataFrame:
    """The parquet table ``{folder}/{name}.parquet`` read as a file stream
    (schema from the current files): a folder of part files, in which new ones
    are picked up as they arrive, or one file.  ``max_files`` limits a
    micro-batch (None: all files there are), which a watermark then follows:
    with fewer than all, rows of later files can be too late for it."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    current = spark.read.parquet(path)
    stream = spark.readStream.schema(current.schema)
    if max_files is not None:
        stream = stream.option("maxFilesPerTrigger", max_files)
    if any(f.endswith(f"/{name}.parquet") for f in current.inputFiles()):  # one file: the stream's source is its folder
        df = stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    else:
        df = stream.parquet(path)
    # few large files per micro-batch -> spread the CPU-heavy text work
    return df.repartition(spark.sparkContext.defaultParallelism) if spread_rows else df


def keyword_label_counts(stream: DataFrame, class_seeds: list[list[str]], id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """Running count of keyword-labelled lines per label (stateful aggregate)."""
    lines = split_lines(stream, id_col, text_col).withColumn("tokens", tokens("line"))
    return keyword_labels(lines, "tokens", class_seeds).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def prototype_label_counts(stream: DataFrame, vec_col: str, kinds, thresholds: dict[str, float],
                           exclude_ids: list[int] | None = None, id_col: str = "vec_id") -> DataFrame:
    """Seed-sentence labelling of a vector stream: every row is scored against
    static (collected, size-checked) prototype sets -- stateless, map-only --
    and confident labels are counted per label combination (the only state)."""
    from seedlabel.operators.prototypes import score_with_prototypes
    from seedlabel.operators.thresholds import keep_confident
    s = stream.filter(~F.col(id_col).isin(exclude_ids)) if exclude_ids else stream
    scored = score_with_prototypes(s, vec_col, kinds)
    for k in kinds:
        scored = scored.withColumn(f"{k.name}_score", F.round(f"{k.name}_score", 6))
    labelled = keep_confident(scored, thresholds)
    return labelled.groupBy(*[k.name for k in kinds]).agg(F.count(F.lit(1)).alias("n"))


def windowed_label_counts(stream: DataFrame, ts_col: str, label_col: str, window: str = "1 hour",
                          watermark: str = "1 hour") -> DataFrame:
    """Label counts per tumbling event-time window; rows later than the
    watermark are dropped and finished windows are emitted once (append)."""
    ts = F.col(ts_col).cast("timestamp")
    return (stream.withColumn("_ts", ts).withWatermark("_ts", watermark)
            .groupBy(F.window("_ts", window).alias("window"), label_col).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    label_col, "n"))


def batch_sink(out: str, mode: str):
    """A ``foreachBatch`` function whose effect is the same however often a
    micro-batch is replayed: it overwrites what that batch wrote before."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/epoch={epoch}")
    return sink


def run_to_table(agg: DataFrame, spark: SparkSession, mode: str = "complete", name: str | None = None) -> str:
    """Run a streaming aggregate until all available input is processed
    (``availableNow``); every micro-batch rewrites the whole parquet table in
    the shared checkpoint folder (complete) or adds its own partition to it
    (append: column ``epoch``).  Returns the table path."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{name or uuid.uuid4().hex}"
    out = f"{base}/table"
    # an input without data starts no micro-batch: the table then holds no rows
    spark.createDataFrame([], agg.schema).write.parquet(out if mode == "complete" else f"{out}/epoch=-1")
    q = (agg.writeStream.outputMode(mode).foreachBatch(batch_sink(out, mode))
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return out
