"""Vocabulary labeler: substitutes -> class vocabularies -> overlap scores ->
z-scores -> labels.

Substitutes.  Where the reference asks a masked language model for the top-K
words that could fill a token position, this engine estimates the same thing
from the corpus itself: the words observed most often between the same left
and right neighbours (``<s>``/``</s>`` at sentence edges).  Any other
substitute table with columns ``(left, right, word, n, rank)`` can be passed
instead.

Scale notes.  Every step is an aggregate or an equi-join on the context key
``(left, right)``; occurrences are pre-aggregated per context before they
meet the substitute table, so no step expands a token into K rows of the big
table.  Per-class statistics are class-count sized and reach the tasks as a
scalar subquery.  :mod:`contexts` has the steps up to the scores for packed
sentences, without a row per token; the queries use it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seedlabel.operators.prototypes import top_k_per_group
from seedlabel.session import broadcast_if_bounded

BOS, EOS = "<s>", "</s>"


def token_positions(df: DataFrame, id_cols, tokens_col: str = "tokens", keep=None) -> DataFrame:
    """One row per token: ``(*ids, left, token, right)``.  With ``keep`` only
    the tokens that pass it, and one row of nulls for a sentence without any."""
    t = F.col(tokens_col)
    n = F.size(t)
    left = F.concat(F.array(F.lit(BOS)), F.slice(t, 1, F.greatest(n - 1, F.lit(0))))
    right = F.concat(F.slice(t, 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(EOS)))
    cells = F.arrays_zip(left.alias("left"), t.alias("token"), right.alias("right"))
    if keep is not None:
        return df.select(*id_cols, F.inline_outer(F.filter(cells, lambda c: keep(c["token"]))))
    return df.select(*id_cols, F.inline(cells))


def context_fillers(positions: DataFrame) -> DataFrame:
    """``(left, right, word, n)``: how often each word fills each context."""
    return positions.groupBy("left", "right", F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def substitutes(fillers: DataFrame, k: int) -> DataFrame:
    """Top-k fillers per context by count (ties: word ascending), with rank 1..k."""
    return top_k_per_group(fillers, ["left", "right"], [F.desc("n"), F.asc("word")], k, rank_col="rank")


def _usable(word_col, filter_words: list[str]):
    w = F.col(word_col)
    return ~w.isin(filter_words) & ~w.contains("##")


def seed_table(spark: SparkSession, class_seeds: list[list[str]]) -> DataFrame:
    rows = [(i, s) for i, seeds in enumerate(class_seeds) for s in dict.fromkeys(seeds)]
    return spark.createDataFrame(rows, "cls int, word string")


def class_vocabulary(positions: DataFrame, subs: DataFrame, seeds: DataFrame,
                     filter_words: list[str], n_seeds: int | None = None) -> DataFrame:
    """``(cls, word, freq)``: for every occurrence of a class seed, each of the
    top substitutes at that position (not a filter word, no ``##``) adds one
    to the word's frequency in that class."""
    bound = n_seeds if n_seeds is not None else seeds.count()
    occ = (positions.join(broadcast_if_bounded(seeds.withColumnRenamed("word", "token"), bound), "token")
           .groupBy("cls", "left", "right").agg(F.count(F.lit(1)).alias("occ")))
    s = subs.filter(_usable("word", filter_words)).select("left", "right", "word")
    return occ.join(s, ["left", "right"]).groupBy("cls", "word").agg(F.sum("occ").alias("freq"))


def disjoint_vocabulary(vocab: DataFrame, m: int) -> DataFrame:
    """Keep (cls, word) only where its freq is the highest over classes (ties
    stay in every tied class); then the top ``m`` per class by (freq desc,
    word desc), with ``rank``."""
    best = vocab.withColumn("_mx", F.max("freq").over(Window.partitionBy("word")))
    kept = best.filter(F.col("freq") == F.col("_mx")).drop("_mx")
    return top_k_per_group(kept, ["cls"], [F.desc("freq"), F.desc("word")], m, rank_col="rank")


def context_class_hits(subs: DataFrame, vocab_m: DataFrame, filter_words: list[str],
                       vocab_bound: int | None = None) -> DataFrame:
    """``(left, right, cls, hits)``: how many of a context's substitutes belong
    to each class, a substitute counting for the first class (lowest index)
    whose vocabulary holds it.  The vocabulary is bounded by classes x m."""
    first = vocab_m.groupBy("word").agg(F.min("cls").alias("cls"))
    s = subs.filter(_usable("word", filter_words))
    # at most classes x m words (the caller passes that bound)
    first = broadcast_if_bounded(first, vocab_bound if vocab_bound is not None else 10 ** 12)
    return s.join(first, "word").groupBy("left", "right", "cls").agg(F.count(F.lit(1)).alias("hits"))


def context_class_hit_arrays(subs: DataFrame, vocab_m: DataFrame, filter_words: list[str], n_classes: int,
                             vocab_bound: int | None = None) -> DataFrame:
    """Like :func:`context_class_hits`, one row per context:
    ``(left, right, hits_by_class array<long>)``."""
    first = vocab_m.groupBy("word").agg(F.min("cls").alias("cls"))
    first = broadcast_if_bounded(first, vocab_bound if vocab_bound is not None else 10 ** 12)
    s = subs.filter(_usable("word", filter_words)).join(first, "word")
    return s.groupBy("left", "right").agg(
        F.array(*[F.count_if(F.col("cls") == c) for c in range(n_classes)]).alias("hits_by_class"))


def tagged_lexicon(tags: DataFrame, keep: list[str]) -> DataFrame:
    """``(word, tag)`` rows -> the distinct words with one of the kept tags."""
    return tags.filter(F.col("tag").isin(keep)).select("word").distinct()


def overlap_scores(sent: DataFrame, id_cols, ctx_hits: DataFrame, n_classes: int,
                   filter_words: list[str], tokens_col: str = "tokens",
                   lexicon: list[str] | DataFrame | None = None, carry=()) -> DataFrame:
    """Dense per-sentence class scores ``(*ids, *carry, n_cand, scores array<double>)``:
    score[c] = substitute hits of class c over the sentence's candidate
    tokens / max(#candidate tokens, 1).  Candidate tokens are the tokens that
    are not filter words and, when a ``lexicon`` is given (e.g. the nouns, or
    the adjectives/adverbs of a tagged word list), are in it: a list of words,
    or a table with a ``word`` column (see :func:`tagged_lexicon`)."""
    ids = list(id_cols)
    table = lexicon if isinstance(lexicon, DataFrame) else None

    def keep(t):
        ok = ~t.isin(filter_words)
        return ok & t.isin(lexicon) if lexicon is not None and table is None else ok

    if "hits_by_class" not in ctx_hits.columns:
        ctx_hits = ctx_hits.groupBy("left", "right").agg(
            F.array(*[F.sum(F.when(F.col("cls") == c, F.col("hits")).otherwise(0)) for c in range(n_classes)])
            .alias("hits_by_class"))
    # candidate tokens only; a sentence without any keeps one row without a context
    pos = token_positions(sent, [*ids, *carry], tokens_col, keep)
    if table is not None:  # a token outside of the lexicon is no candidate: its context goes, its sentence stays
        known = table.select(F.col("word").alias("token"), F.lit(True).alias("_known")).distinct()
        pos = pos.join(known, "token", "left").select(*ids, *carry, *[
            F.when(F.col("_known"), F.col(c)).alias(c) for c in ("left", "token", "right")])
    # one row per context (already partitioned by the context key), so only the positions move
    j = pos.join(ctx_hits, ["left", "right"], "left")
    sums = j.groupBy(*ids).agg(*[F.first(c).alias(c) for c in carry], F.count("token").alias("n_cand"), *[
        F.coalesce(F.sum(F.col("hits_by_class")[c]), F.lit(0)).cast("double").alias(f"_h{c}") for c in range(n_classes)])
    n = F.greatest(F.col("n_cand"), F.lit(1))
    return sums.select(*ids, *carry, F.col("n_cand").cast("int").alias("n_cand"),
                       F.array(*[F.col(f"_h{c}") / n for c in range(n_classes)]).alias("scores"))


def class_score_stats(scores: DataFrame, scores_col: str = "scores", n_classes: int | None = None) -> DataFrame:
    """``(cls, mean, sd)`` with the population standard deviation."""
    if n_classes is not None:        # a column per class, no row
        x = [F.col(scores_col)[c] for c in range(n_classes)]
        one = scores.agg(*[f(v).alias(f"{k}{c}") for c, v in enumerate(x)
                           for k, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop))])
        rows = F.array(*[F.struct(F.lit(c).alias("cls"), F.col(f"mean{c}").alias("mean"), F.col(f"sd{c}").alias("sd"),
                                  F.col(f"n{c}").alias("n")) for c in range(n_classes)])
        return one.select(F.inline(rows)).filter(F.col("n") > 0).drop("n")
    e = scores.select(F.posexplode(scores_col).alias("cls", "x"))
    return e.groupBy(F.col("cls").cast("int").alias("cls")).agg(F.avg("x").alias("mean"),
                                                                 F.stddev_pop("x").alias("sd"))


def zscores(scores: DataFrame, stats: DataFrame, scores_col: str = "scores", out_col: str = "z",
            n_classes: int | None = None) -> DataFrame:
    """Standardise every class score with that class's mean and sd.

    The stats (one row per class) reach the tasks as a scalar subquery.  The
    stats may come from another table (e.g. train statistics applied to test
    scores).  sd = 0 gives NULL, which never passes a threshold.
    """
    st = stats.select(F.array_sort(F.collect_list(F.struct("cls", "mean", "sd"))).alias("s")).scalar()
    if n_classes is not None:        # plain expressions (whole-stage codegen), one per class
        sc, s_ = F.col(scores_col), F.col("_st")
        z = F.array(*[F.try_divide(sc[c] - s_[c]["mean"], s_[c]["sd"]) for c in range(n_classes)])
    else:
        z = F.transform(F.col(scores_col),
                        lambda x, i: F.try_divide(x - F.col("_st")[i]["mean"], F.col("_st")[i]["sd"]))
    return scores.withColumn("_st", st).withColumn(out_col, z).drop("_st")


def zscore_labels(z: DataFrame, lam: float, z_col: str = "z", label_col: str = "label",
                  n_classes: int | None = None) -> DataFrame:
    """Rows where exactly one class reaches ``lam``; that class is the label."""
    if n_classes is not None:
        m = F.array_compact(F.array(*[F.when(F.col(z_col)[c] >= F.lit(lam), F.lit(c)) for c in range(n_classes)]))
    else:
        m = F.filter(F.transform(F.col(z_col), lambda x, i: F.when(x >= F.lit(lam), i)), lambda x: x.isNotNull())
    return (z.withColumn("_m", m).filter(F.size("_m") == 1)
            .withColumn(label_col, F.col("_m")[0].cast("int")).drop("_m"))


def zscore_forced(z: DataFrame, z_col: str = "z", label_col: str = "label", floor: float = -100.0) -> DataFrame:
    """Force one label per row: the first class with the highest z (strictly
    above ``floor``; NULL z never wins).  Rows where no class beats the floor
    are dropped.  ``array_max`` skips NULLs and ``array_position`` finds the
    first maximum, so no lambda is needed."""
    zc = F.col(z_col)
    mx = F.array_max(zc)
    best = F.when(mx > F.lit(floor), F.struct((F.array_position(zc, mx) - 1).cast("int").alias("i"),
                                              mx.alias("z"))) \
        .otherwise(F.struct(F.lit(-1).alias("i"), F.lit(floor).alias("z")))
    return (z.withColumn("_b", best).filter(F.col("_b.i") >= 0)
            .withColumn(label_col, F.col("_b.i").cast("int")).withColumn("z_best", F.col("_b.z")).drop("_b"))
