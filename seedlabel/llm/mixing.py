"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Source weights cycle through (5, 2, 1) over the sources in code-point order
(null last).  The sources share ``share`` (1.5) times the total size by
weight; a target stops at ``max_epochs`` (2) times its source's size and the
excess is shared again by weight, which is the level L with
sum(min(2 size, weight L)) = total, found by prefix sums over the sources.

Inside a source the target is first spent on complete epochs (every document
once more) and the rest on a fractional selection: each document gets the key
-ln(u) / w, u from the MD5 digest of its identifier and the seed, w its
quality weight; in ascending key order documents are taken until the budget is
used up.  The document in which it ends gives only its first words, so a
source's taken words equal the whole part of its target.

Scale: keys are bucketed (``BUCKETS`` per source); sizes are pre-aggregated by
(source, bucket), prefix sums run over those bounded tables, and only the one
bucket per source in which the budget ends is sorted, to find the last key
taken.  A source with a third of all rows is therefore never gathered.  The
final pass is a filter against one row per source (broadcast behind a checked
row count).

Null texts have size 0; they and empty texts are taken 0 words (the operator
still gives them their source's complete epochs and places them by key).  Null
sources are one source.  Ties of the key are ordered by identifier (null
first), then by text digest; rows equal in all of these take equal shares
(rounded down) of what the budget leaves to them.  An empty
table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedlabel.llm.common import WORD_RUN, broadcast_checked, hex60, scratch_table, word_count

SOURCE_WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Key buckets per source: bounds the prefix table and splits a source's sort.
BUCKETS = 4096
#: Weights, from the smallest quality weight to 1, whose keys the buckets are cut for: a
#: bucket has at most 5 * 2.5 / BUCKETS of the documents of any weight between them.
BUCKET_WEIGHTS = (0.05, 0.1, 0.25, 0.5, 1.0)
#: Rows of the source table up to which it is broadcast.
MAX_BROADCAST_SOURCES = 100_000
#: Characters that mark noise; a document's weight falls with their share.
NOISE = "!#$%&*|"


def quality_weight(text: Column) -> Column:
    """Weight in [0.05, 1]: one less five times the share of noise characters."""
    text = F.coalesce(text, F.lit(""))
    noise = F.length(text) - F.length(F.translate(text, NOISE, ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(5.0) * noise / F.greatest(F.length(text), F.lit(1)))


def sampling_key(ident: Column, weight: Column, seed: str = SEED) -> Column:
    """Efraimidis-Spirakis key -ln(u) / weight, u in (0, 1) from a digest."""
    u = (hex60(F.concat(F.lit(seed + ":"), F.coalesce(ident.cast("string"), F.lit("")))) + 0.5) / float(1 << 60)
    return -F.ln(u) / weight


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             seed: str = SEED) -> list[Column]:
    """The columns the mix needs of a document: mix_source, mix_size, mix_key, mix_tie."""
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    return [F.col(f"`{source_col}`").alias("mix_source"), word_count(text).alias("mix_size"),
            sampling_key(ident, quality_weight(text), seed).alias("mix_key"),
            F.md5(F.coalesce(text, F.lit(""))).alias("mix_tie")]


def bucket_of(key: Column) -> Column:
    """Bucket of a key; 1 - exp(-w key) rises from 0 to 1 and deals keys of weight w evenly, so
    the mean over BUCKET_WEIGHTS follows the key order and deals the keys of any weight."""
    even = sum((F.lit(1.0) - F.exp(-key * w) for w in BUCKET_WEIGHTS), F.lit(0.0)) / len(BUCKET_WEIGHTS)
    return F.least(F.floor(even * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def targets(sizes: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(mix_source, source_size) -> with ``target``: one row per source."""
    order = Window.orderBy(F.col("mix_source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in SOURCE_WEIGHTS])
    nth = (F.row_number().over(order) - 1) % len(SOURCE_WEIGHTS)
    t = sizes.select("mix_source", "source_size", F.get(cycle, nth).alias("w"))
    t = t.withColumn("cap", (F.lit(max_epochs) * F.col("source_size")).cast("double"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # sources reach their cap in the order of cap / weight: k capped sources leave
    # (total - their caps) to the weights of the others
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")), F.col("mix_source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = (t.withColumn("total", F.lit(share) * F.sum("source_size").over(every))
         .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("w").over(after)))
    # the first source (in ratio order) that the level leaves below its cap sets the level
    t = t.withColumn("fits", F.col("w") * F.col("level") <= F.col("cap"))
    t = t.withColumn("place", F.row_number().over(by_ratio))
    first = F.min(F.when(F.col("fits"), F.struct("place", "level")))
    t = t.withColumn("final", first.over(every)["level"])
    return t.select("mix_source", "source_size",
                    F.when(F.col("final").isNull(), F.col("cap"))
                    .otherwise(F.least(F.col("cap"), F.col("w") * F.col("final"))).alias("target"))


def plan(rows: DataFrame) -> DataFrame:
    """Measured rows (mix_source, mix_size, mix_key, mix_id, mix_tie) -> one row
    per source: source_size, target, epochs, and where the fractional selection
    ends: the bucket, and the last row with the words it gives (null: nowhere)."""
    rows = rows.withColumn("bucket", bucket_of(F.col("mix_key")))
    cells = scratch_table(rows.groupBy("mix_source", "bucket").agg(F.sum("mix_size").alias("cell_size")), "mix-cells")
    t = targets(cells.groupBy("mix_source").agg(F.sum("cell_size").alias("source_size")))
    t = (t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                      .otherwise(0).cast("int"))
         .withColumn("rest", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")))
    t = broadcast_checked(scratch_table(t, "mix-targets"), MAX_BROADCAST_SOURCES)
    run = Window.partitionBy("mix_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("cell_size").over(run), F.lit(0)))
    same = lambda a, b: a["mix_source"].eqNullSafe(b["mix_source"])
    edge = (cells.join(t, same(cells, t)).filter("before < rest")
            .groupBy(cells["mix_source"].alias("edge_source"))
            .agg(F.max(F.struct("bucket", "before", "rest")).alias("e"))
            .select("edge_source", F.col("e.bucket").alias("edge_bucket"), "e.before", "e.rest"))
    edge = broadcast_checked(scratch_table(edge, "mix-edges"), MAX_BROADCAST_SOURCES)
    near = rows.join(edge, rows["mix_source"].eqNullSafe(edge["edge_source"])
                     & (rows["bucket"] == edge["edge_bucket"]))
    near = near.groupBy("mix_source", "before", "rest", "mix_key", "mix_id", "mix_tie").agg(
        F.sum("mix_size").alias("words"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("mix_source").orderBy("mix_key", F.col("mix_id").asc_nulls_first(), "mix_tie")
    prior = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = (near.withColumn("start", F.col("before") + prior).filter("start < rest")
            .withColumn("part", F.least(F.floor((F.col("rest") - F.col("start")) / F.col("n")),
                                        F.floor(F.col("words") / F.col("n"))).cast("long"))
            .groupBy(F.col("mix_source").alias("edge_source"))
            .agg(F.max(F.struct(F.struct("mix_key", "mix_id", "mix_tie").alias("row"), "part")).alias("last")))
    e = edge.join(last, edge["edge_source"].eqNullSafe(last["edge_source"]), "left").select(
        edge["edge_source"], "edge_bucket", "last")
    return t.join(e, t["mix_source"].eqNullSafe(e["edge_source"]), "left").select(
        t["mix_source"].alias("plan_source"), "source_size", "target", "epochs", "edge_bucket", "last")


def taken(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Measured rows with their source's plan, ``epochs`` and ``part``: the
    words that the fractional selection takes of the row."""
    planned = broadcast_checked(scratch_table(planned, "mix-plan"), MAX_BROADCAST_SOURCES)
    j = rows.join(planned, rows["mix_source"].eqNullSafe(planned["plan_source"]))
    me, last = F.struct("mix_key", "mix_id", "mix_tie"), F.col("last.row")
    part = (F.when(bucket_of(F.col("mix_key")) < F.col("edge_bucket"), F.col("mix_size"))
            .when((bucket_of(F.col("mix_key")) > F.col("edge_bucket")) | F.col("last").isNull(), F.lit(0))
            .when(me < last, F.col("mix_size")).when(me == last, F.col("last.part")).otherwise(F.lit(0)))
    return j.withColumn("part", part.cast("long"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document."""
    rows = docs.select(F.col("doc_id").alias("mix_id"), *measured(docs))
    rows = scratch_table(rows, "mix-rows")  # narrow: the texts are read and counted once
    return taken(rows, plan(rows)).select(
        F.col("mix_id").alias("doc_id"), F.col("mix_size").alias("size"), "source_size", "target",
        (F.col("epochs") * F.col("mix_size") + F.col("part")).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as many times as it is taken.
    A document of which only the first words are taken gets these, joined by
    one blank, as its text (and their length as ``n_chars``, if there is one)."""
    cols = docs.columns
    narrow = scratch_table(docs.select(F.col("doc_id").alias("mix_id"), *measured(docs)), "mix-rows")
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("mix_row"),
                       F.col("doc_id").alias("mix_id"), *measured(docs))
    picked = taken(wide, plan(narrow))
    whole = F.col("epochs") + ((F.col("part") > 0) & (F.col("part") == F.col("mix_size"))).cast("int")
    cut = (F.col("part") > 0) & (F.col("part") < F.col("mix_size"))
    copies = F.concat(F.array_repeat(F.lit(False), whole), F.when(cut, F.array(F.lit(True))).otherwise(F.array()))
    out = picked.select("mix_row", "part", F.explode(copies).alias("mix_cut"))
    words = F.slice(F.regexp_extract_all(F.col("mix_row.text"), F.lit(WORD_RUN), F.lit(0)), 1,
                    F.col("part").cast("int"))
    out = out.withColumn("mix_text", F.when(F.col("mix_cut"), F.array_join(words, " ")).otherwise(F.col("mix_row.text")))
    changed = {"text": F.col("mix_text")}
    if "n_chars" in cols:
        changed["n_chars"] = F.when(F.col("mix_cut"), F.length("mix_text")).otherwise(F.col("mix_row.n_chars")) \
            .cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col("mix_row").getField(c)).alias(c) for c in cols])
