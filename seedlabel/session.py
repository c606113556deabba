"""Session helpers: building a session, locating the shared checkpoint folder,
and reading the input tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, cpus: int | None = None, app: str = "seedlabel",
              extra: dict | None = None) -> SparkSession:
    """Return a session tuned for this library.

    On a cluster the master and sizing come from spark-submit; these defaults
    only matter for local runs (tests, bench).  Shuffle partitions start at
    2x cores and AQE coalesces/splits them at runtime.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_MASTER"):
        b = b.master(master or f"local[{cpus}]")
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(max(2 * cpus, 8)),
        "spark.default.parallelism": str(max(2 * cpus, 8)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "8192",
        "spark.driver.memory": os.environ.get("SEEDLABEL_DRIVER_MEMORY", "12g"),
        "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
        # checkpoint files of DataFrames that are gone are removed
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; that setting always wins.
    Only on a local master (tests) an unset folder is replaced by a private
    one; on a cluster a folder of the driver's machine would be lost to the
    executors, so an unset folder is an error there.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # no driver-side context (e.g. a Connect session): the server's setting applies
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not re.match(r"local($|\[)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="seedlabel-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def written_table(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back:
    cuts the lineage with a columnar table that any executor can read again."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written_at(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None,
               compression: str | None = None) -> DataFrame:
    """:func:`written_table` at a given path, in the place of what an earlier
    step left there, or behind it (``append``); ``compression`` "none" for
    numbers that are packed already or leave nothing to a codec."""
    df.write.mode(mode).parquet(path, partitionBy=by, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(spark: SparkSession, path: str) -> None:
    """Leave an empty table at a path whose rows are not read again."""
    spark.createDataFrame([], "none int").write.mode("overwrite").parquet(path)


#: Tables written meanwhile leave no shuffle files: they are removed at the end
#: of each write, not only when the driver's collector finds them.
NO_SHUFFLES_LEFT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A union of tables of one partition each keeps their tasks apart.
UNION_APART = {"spark.sql.unionOutputPartitioning": "false"}

#: Rows of several MB are read one by one: a batch of them would be a file in memory.
ROW_BY_ROW = {"spark.sql.parquet.columnarReaderBatchSize": "1"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Run what is inside with some settings, and put back the former ones."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (``{sf_dir}/{name}.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """A parquet table, or None when its path does not exist; any other read
    error is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over the cluster's parallelism when the scan
    offers fewer partitions than that (e.g. one large parquet row group);
    CPU-heavy per-row text work then uses every core.  On large inputs the
    scan already has enough partitions and this is a no-op."""
    try:
        par = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # no driver-side context: leave the plan as it is
        return df
    return df.repartition(par) if n < par else df


# Largest size (rows by their parameter-derived bound, times bytes of a row) at
# which a side is broadcast; above it the join is left to Spark's shuffle strategies.
MAX_BROADCAST_BYTES = 32 * 1024 * 1024


def broadcast_if_bounded(df: DataFrame, row_bound: int, row_bytes: int = 128,
                         limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only for a side whose row count is bounded by
    construction (``row_bound`` comes from parameters: classes x seeds,
    classes x vocabulary size, a validation count, ...) and whose rows (short
    keys and numbers, ``row_bytes`` each) stay within ``limit`` bytes.
    Beyond the limit no hint is given, so a sort-merge (or AQE-chosen) join
    is used instead."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if row_bound * row_bytes <= limit else df
