"""Corpus -> sentences, and per-sentence token statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.functions.text import py_strip, raw_sentence_pieces, tokens


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    keep=()) -> DataFrame:
    """One row per sentence: ``(id, pos, sentence, *keep)``; ``pos`` counts from 0
    within the document.  Map-only (generator over each row's own text); the
    pieces are exploded first and stripped per row, so no lambda is needed."""
    ex = df.select(F.col(id_col), *keep, F.posexplode(raw_sentence_pieces(text_col)).alias("pos", "_piece"))
    return ex.select(F.col(id_col), *keep, "pos", py_strip("_piece").alias("sentence"))


def split_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """One row per text line ``(id, line_no, line)``; the final newline of a
    text does not open an extra line."""
    lines = F.split(F.regexp_replace(F.col(text_col), "\n\\z", ""), "\n", -1)
    return df.select(F.col(id_col), *keep, F.posexplode(lines).alias("line_no", "line"))


def sentence_stats(sentences: DataFrame, groups=("lang",), digits: int = 6) -> DataFrame:
    """Per group: sentences, empty sentences, tokens, mean and max tokens per sentence."""
    n_tok = F.size(tokens("sentence"))
    return (sentences.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("sentences"),
        F.count_if(F.col("sentence") == "").alias("empty_sentences"),
        F.sum(n_tok).cast("long").alias("tokens"),
        F.round(F.avg(n_tok), digits).alias("avg_tokens"),
        F.max(n_tok).cast("long").alias("max_tokens")))
