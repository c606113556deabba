"""Sentence embeddings as a cached table.

Any per-batch encoder (``fn(texts: pandas.Series) -> 2-D numpy array``) is
run through ``mapInPandas`` on the texts that are not cached yet (anti-join
on the cache key), the new vectors are appended to the cache table, and the
caller gets the embeddings of all requested texts.  Batches follow
``spark.sql.execution.arrow.maxRecordsPerBatch``.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedlabel.session import read_if_present

Encoder = Callable[[pd.Series], np.ndarray]


def text_key(col: str = "text"):
    """Cache key of a text: sha2 of the text (with the encoder name outside)."""
    return F.sha2(F.col(col), 256)


def encode(df: DataFrame, encoder: Encoder, text_col: str = "text", key_col: str = "key") -> DataFrame:
    """``(key, embedding array<float>)`` for every row, computed by the encoder."""
    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            vecs = np.asarray(encoder(pdf[text_col]), dtype=np.float32)
            yield pd.DataFrame({key_col: pdf[key_col].to_numpy(), "embedding": list(vecs)})
    return df.select(key_col, text_col).mapInPandas(run, f"{key_col} string, embedding array<float>")


def embed_with_cache(spark: SparkSession, texts: DataFrame, encoder: Encoder, cache_path: str, encoder_name: str,
                     text_col: str = "text") -> DataFrame:
    """Embeddings of ``texts`` (all columns kept, plus ``embedding``), encoding
    only the distinct texts missing from the cache at ``cache_path``."""
    keyed = texts.withColumn("key", F.concat_ws(":", F.lit(encoder_name), text_key(text_col)))
    cache = read_if_present(spark, cache_path)
    todo = keyed.select("key", text_col).dropDuplicates(["key"])
    if cache is not None:
        todo = todo.join(cache.select("key"), "key", "left_anti")
    encode(todo, encoder, text_col).write.mode("append").parquet(cache_path)
    cache = spark.read.parquet(cache_path).dropDuplicates(["key"])  # two runs may have encoded the same text
    return keyed.join(cache, "key").drop("key")
