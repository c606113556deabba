"""Readers.  Every reader takes an explicit schema (no inference) and returns
a DataFrame; none pulls data to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedlabel.functions.text import collapse_spaces, py_strip, word_tokens_joined
from seedlabel.operators.splits import global_index

GOLD_SCHEMA = "id long, aspect int, polarity int, sentence string"

OPINION_XML_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("Opinions", T.StructType([T.StructField("Opinion", T.ArrayType(T.StructType([
        T.StructField("_target", T.StringType()),
        T.StructField("_category", T.StringType()),
        T.StructField("_polarity", T.StringType()),
    ])))])),
])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Line corpus: ``(file, line_id, text)``.  ``line_id`` grows with the
    position in the input (partition, then row); write the result before
    using ``line_id`` as a key in another job."""
    return (spark.read.text(path).select(F.col("_metadata.file_path").alias("file"),
                                         F.monotonically_increasing_id().alias("line_id"),
                                         F.col("value").alias("text")))


def read_gold_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``index \\t aspect \\t polarity \\t sentence`` with quoting disabled (the
    text keeps raw quote characters); the sentence is stripped like a line."""
    df = (spark.read.option("sep", "\t").option("quote", "").option("escape", "").option("header", "false")
          .option("mode", "FAILFAST").schema(GOLD_SCHEMA).csv(path))
    return df.withColumn("sentence", py_strip("sentence"))


def read_review_csv(spark: SparkSession, path: str, schema: str = "restoId string, reviewScoreOverall string, "
                                                                     "reviewText string") -> DataFrame:
    """Review export: header, decimal comma scores, texts stored as Python
    bytes literals.  Returns ``(restoId, score double, text)`` with the text
    decoded, lower-cased and word-tokenised (tokens joined by blanks)."""
    from seedlabel.functions.decode import decode_bytes_literal
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').schema(schema).csv(path)
    score = F.regexp_replace("reviewScoreOverall", ",", ".").try_cast("double")
    text = decode_bytes_literal(F.coalesce(F.col("reviewText"), F.lit("b''")))
    return df.select("restoId", score.alias("score"), word_tokens_joined(text).alias("text"))


def read_opinion_xml(spark: SparkSession, path: str) -> DataFrame:
    """Opinion XML (``<sentence id><text/><Opinions><Opinion .../>``) ->
    one row per opinion: ``sentence_index, sentence, sent_len, opinion_num,
    opinion_count, polarity, target, category``.  ``sentence_index`` is the
    sentence's position in the file (0-based)."""
    raw = spark.read.format("xml").option("rowTag", "sentence").schema(OPINION_XML_SCHEMA).load(path)
    raw, order = in_file_order(raw)
    idx = global_index(raw, order, "sentence_index")
    ops = F.coalesce(F.col("Opinions.Opinion"), F.array().cast(OPINION_XML_SCHEMA["Opinions"].dataType["Opinion"]
                                                                 .dataType))
    base = idx.select("sentence_index", word_tokens_joined("text").alias("sentence"),
                      F.size(F.split(F.trim(collapse_spaces("text")), " ")).alias("sent_len"),
                      F.size(ops).alias("opinion_count"), F.posexplode(ops).alias("_p", "op"))
    return base.select("sentence_index", "sentence", "sent_len", (F.col("_p") + 1).alias("opinion_num"),
                       "opinion_count", F.col("op._polarity").alias("polarity"), F.col("op._target").alias("target"),
                       F.col("op._category").alias("category"))


def in_file_order(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows of a file scan with columns that order them as the files do:
    file path, then the split's byte offset, then the row inside the split
    (Spark packs splits of several files into one task by size, so the task
    and row number alone do not follow the files)."""
    order = ["_file", "_block", "_row"]
    return (df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_block", F.col("_metadata.file_block_start"))
            .withColumn("_row", F.monotonically_increasing_id())), order


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(idx, line, file)`` with idx the 0-based line position over the files
    in path order (distributed index)."""
    raw, order = in_file_order(spark.read.text(path))
    return global_index(raw, order, "idx").select("idx", F.col("value").alias("line"), F.col("_file").alias("file"))


def read_line_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Ordered lines of files that hold two lines per record; a file with an
    odd number of lines is refused, so a pair never spans two files."""
    lines = read_ordered_lines(spark, path)
    odd = lines.groupBy("file").count().filter(F.col("count") % 2 == 1).select("file").take(1)
    if odd:
        raise ValueError(f"{odd[0].file}: odd number of lines in a file of two lines per record")
    return lines.withColumn("record", F.floor(F.col("idx") / 2).cast("long"))


def read_label_file(spark: SparkSession, path: str, aspects: list[str], polarities: list[str]) -> DataFrame:
    """Two lines per record: the sentence, then ``aspect polarity`` names ->
    ``(record, sentence, aspect int, polarity int)`` (indices by list order)."""
    from seedlabel.operators.keywords import encode_labels
    lines = read_line_pairs(spark, path)
    rec = lines.groupBy("record").agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("line"))).alias("sentence"),
                                      F.max(F.when(F.col("idx") % 2 == 1, F.col("line"))).alias("labels"))
    parts = F.split(F.trim("labels"), " ")
    return rec.select("record", "sentence", encode_labels(F.try_element_at(parts, F.lit(1)), aspects).alias("aspect"),
                      encode_labels(F.try_element_at(parts, F.lit(2)), polarities).alias("polarity"))


def read_score_file(spark: SparkSession, path: str) -> DataFrame:
    """Two lines per record: the sentence, then `` name: value`` pairs ->
    long ``(record, class_name, score)``."""
    lines = read_line_pairs(spark, path).filter(F.col("idx") % 2 == 1)
    pairs = F.regexp_extract_all(F.col("line"), F.lit(r"(\S+): (\S+)"), 0)
    e = lines.select("record", F.explode(pairs).alias("kv"))
    kv = F.split(F.col("kv"), ": ")
    return e.select("record", kv[0].alias("class_name"), kv[1].try_cast("double").alias("score"))


def read_results(spark: SparkSession, paths: list[str], type_: str | None = None,
                 domain: str | None = None) -> DataFrame:
    """Run-result tables of several models (one CSV per model folder); the
    model is the name of the file's folder."""
    df = (spark.read.option("header", "true").option("inferSchema", "false").csv(paths)
          .withColumn("model", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)))
    if type_ is not None:
        df = df.filter(F.col("type") == type_)
    if domain is not None:
        df = df.filter(F.col("domain") == domain)
    return df.withColumn("f1_score", F.col("`f1-score`").cast("double"))


def read_embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


