"""Bounded samples of labelled documents for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(ident: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the identifier as text, modulo: rows never used for learning
    (a null identifier is not held out, and has no label either)."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def label_rows(labels: DataFrame, label: str, modulus: int, remainder: int) -> DataFrame:
    """(label_id, y) of the rows that may be learned from; identifiers with
    contradicting labels are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(f"`{label}`").cast("int").alias("y"))
    rows = rows.filter("y in (0, 1) and label_id is not null").filter(~held_out(F.col("label_id"), modulus, remainder))
    return (rows.groupBy("label_id").agg(F.min("y").alias("y"), F.max("y").alias("other"))
            .filter("y = other").drop("other"))


def sample(docs: DataFrame, rows: DataFrame, per_class: int, columns: list[str]) -> DataFrame:
    """(label_id, y, columns) of at most ``per_class`` labelled documents of each
    class, chosen by a hash of the identifier: one row per identifier."""
    pick = None
    for y in (0, 1):
        part = rows.filter(F.col("y") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(per_class)
        pick = part if pick is None else pick.unionByName(part)
    pick = F.broadcast(pick)  # at most 2 x per_class rows
    found = docs.select(F.col("doc_id").cast("long").alias("label_id"), *[F.col(f"`{c}`") for c in columns])
    found = found.join(pick, "label_id")
    return (found.groupBy("label_id", "y").agg(F.min(F.struct(*columns)).alias("row"))
            .select("label_id", "y", "row.*"))
