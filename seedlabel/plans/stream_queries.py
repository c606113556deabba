"""Streaming query: keyword labelling of a document stream with running
label counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedlabel.plans import embedding_queries as EQ
from seedlabel.plans import text_queries as TQ
from seedlabel.streaming.scorer import keyword_label_counts, prototype_label_counts, run_to_table, stream_table


def q_stream_label_counts(spark, sf_dir):
    agg = keyword_label_counts(stream_table(spark, sf_dir, "documents", spread_rows=True), TQ.LANG_SEEDS)
    return spark.read.parquet(run_to_table(agg, spark, "complete"))


def q_stream_seed_label_counts(spark, sf_dir):
    """Prototypes are built once from the batch table (bounded, size-checked);
    the embeddings then arrive as a stream and are labelled and counted."""
    pa, pp = EQ.embedding_prototypes(EQ.embedding_input(spark, sf_dir))
    seed_ids = sorted({int(i) for p in (pa, pp) for i in p.proto_ids if i >= 0})
    raw = stream_table(spark, sf_dir, "embeddings")
    stream = raw.select("vec_id", "embedding", F.col("label").alias("gold_aspect"))
    agg = prototype_label_counts(stream, "embedding", [pa, pp],
                                 {"aspect_score": EQ.ASPECT_THRESHOLD, "polarity_score": EQ.POLARITY_THRESHOLD},
                                 exclude_ids=seed_ids)
    return spark.read.parquet(run_to_table(agg, spark, "complete"))


QUERIES = {"stream_label_counts": q_stream_label_counts,
           "stream_seed_label_counts": q_stream_seed_label_counts}
ORACLE = {"stream_label_counts": "WITH " + TQ.KEYWORD_CTE + "\nSELECT label, count(*) AS n FROM kl GROUP BY label",
          "stream_seed_label_counts": EQ.ORACLE["label_counts"]}
