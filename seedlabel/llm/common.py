"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedlabel.session import checkpoint_dir

#: White space that separates words: the blank and the controls 0x09 to 0x0D.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_RUN = r"[^\x20\x09-\x0D]+"

#: Bytes of text handled at once inside a task (numpy work arrays are a small
#: multiple of it), so a task's memory does not follow the Arrow batch size.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch sent to Python.
BATCH_BYTES = 4 << 20


def scratch_table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the
    lineage with files every executor can read again after a loss."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_checked(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for a written table whose counted rows stay within
    ``max_rows``; beyond it the join is left to Spark's shuffle strategies."""
    return F.broadcast(df) if df.count() <= max_rows else df


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after limiting the session's Arrow batches to BATCH_BYTES: a
    batch of texts is held by the JVM, the socket and the Python worker at
    once, and Spark's default (64 MB) takes several times that per task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def sliced(batches: Iterator[pa.RecordBatch], text_col: int, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``max_bytes`` of text
    each; a single longer row makes a run of its own."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text_col)).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            n = n or 0
            if i > start and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def filter_batches(df: DataFrame, keep: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows of ``df`` that a batch filter keeps, all columns unchanged (any
    column names: they are numbered on the way)."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(keep, plain.schema).toDF(*df.columns)


def word_count(text: Column) -> Column:
    """Number of white-space separated words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RUN)), F.lit(0)).cast("long")


def text_bytes(text: Column) -> Column:
    """The text's UTF-8 bytes, null as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b"")).cast("binary")


def hex60(text: Column) -> Column:
    """A 60-bit number from the MD5 digest of a string (the same in any SQL engine)."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
