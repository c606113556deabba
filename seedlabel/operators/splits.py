"""Deterministic splits: hash-uniform Bernoulli cuts, exact-count cuts, and a
distributed global index for "first x% in file order" cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedlabel.session import broadcast_if_bounded

TWO_POW_32 = 4294967296.0


def hash_uniform(*cols) -> Column:
    """A uniform in [0, 1) from the first 32 bits of md5 of the key text.
    The same value is computable in any SQL engine with md5 and hex parsing."""
    key = F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def global_index(df: DataFrame, order_cols: list[str], out_col: str = "idx") -> DataFrame:
    """0-based position of every row in ``order_cols`` order, without moving
    all rows into one partition.

    Range-partition and sort within partitions, stamp each row with its
    partition id and in-partition sequence number, cut the lineage with a
    reliable checkpoint (so the assignment is fixed even if a task is rerun),
    then add the row counts of all earlier partitions (a table with one row
    per partition, broadcast).
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_seq", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    # one row per partition
    return (ranged.join(broadcast_if_bounded(offsets, n), "_pid")
            .withColumn(out_col, F.col("_off") + F.col("_seq")).drop("_pid", "_seq", "_off"))


def corpus_split(docs: DataFrame, id_col: str, u_col: str = "u", test_below: float = 0.0005,
                 keep_prob: float = 0.8, dev_share: float = 0.05) -> DataFrame:
    """train / dev / weak assignment.

    u < test_below -> test; u < keep_prob -> train; else test.  Then, in id
    order, the first floor(dev_share * #test) test rows are dev and all other
    test rows form the weak-label corpus.
    """
    u = F.col(u_col)
    d = docs.withColumn("_b", F.when(u < keep_prob, F.when(u < test_below, "test").otherwise("train"))
                        .otherwise("test"))
    train = d.filter(F.col("_b") == "train").select(id_col, F.lit("train").alias("split"))
    test = global_index(d.filter(F.col("_b") == "test").select(id_col), [id_col], "_i")
    n_test = test.agg(F.count(F.lit(1)).alias("n")).scalar()
    cut = F.floor(n_test * F.lit(dev_share))
    t = test.select(id_col, F.when(F.col("_i") < cut, "dev").otherwise("weak").alias("split"))
    return train.unionByName(t)


def exact_count_split(df: DataFrame, key_cols: list[str], n_validation: int, u_col: str = "u") -> DataFrame:
    """Exactly ``n_validation`` rows (smallest hash-uniform, ties by key) are
    'validation', the rest 'train'.  The chosen keys come from a bounded
    top-n (TakeOrderedAndProject) and are broadcast back."""
    chosen = df.orderBy(u_col, *key_cols).limit(n_validation).select(*key_cols, F.lit(True).alias("_v"))
    return (df.join(broadcast_if_bounded(chosen, n_validation), key_cols, "left")
            .select(*key_cols, F.when(F.col("_v"), "validation").otherwise("train").alias("split")))

