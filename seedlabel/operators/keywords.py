"""Keyword labeler: a text is labelled with a class iff seeds of exactly one
class occur among its tokens (exact, case-sensitive token match)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matched_classes(tokens, class_seeds: list[list[str]]) -> Column:
    """Ascending array of class indices whose seed set intersects the tokens."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    arr = F.array(*[F.when(F.arrays_overlap(t, F.array(*[F.lit(s) for s in seeds])), F.lit(i))
                    for i, seeds in enumerate(class_seeds)])
    return F.array_compact(arr)


def keyword_labels(df: DataFrame, tokens_col: str, class_seeds: list[list[str]],
                   label_col: str = "label", keep_all: bool = False) -> DataFrame:
    """Rows matching exactly one class, with that class as ``label_col``; with
    ``keep_all`` the other rows, too, without a label."""
    m = df.withColumn("_m", matched_classes(tokens_col, class_seeds))
    label = F.col("_m")[0].cast("int")
    if keep_all:
        return m.withColumn(label_col, F.when(F.size("_m") == 1, label)).drop("_m")
    return m.filter(F.size("_m") == 1).withColumn(label_col, label).drop("_m")


def keyword_match_counts(df: DataFrame, tokens_col: str, class_seeds: list[list[str]], groups=()) -> DataFrame:
    """How many rows match 0, 1, 2, ... classes (conflicts are rows with >= 2)."""
    m = F.size(matched_classes(tokens_col, class_seeds)).cast("int").alias("n_matched")
    return df.groupBy(*groups, m).agg(F.count(F.lit(1)).alias("lines"))


def encode_labels(col, classes: list[str]) -> Column:
    """Class name -> index by list order (the list order is the encoding); -1 if unknown."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.array_position(F.array(*[F.lit(x) for x in classes]), c) - 1).cast("int")


def decode_labels(col, classes: list[str]) -> Column:
    """Class index -> name; NULL when out of range."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_element_at(F.array(*[F.lit(x) for x in classes]), c + 1)
