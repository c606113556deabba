"""Gold-set builder over opinion rows (one row per opinion of a sentence).

Input columns: ``sentence_index, opinion_num, opinion_count, polarity,
target, category`` (``GROUP#SUB``).  Steps: split the category, flag
implicit targets, domain filter on the group, keep sentences whose surviving
opinions are all of one group with none filtered away and a non-neutral
polarity, keep opinion 1, recode.  Windows are per sentence (a sentence holds
a handful of opinions), so no window partition grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def recode(col, mapping: dict[str, object]) -> Column:
    """Mapped values replaced, unmatched values passed through (as strings)."""
    c = F.col(col) if isinstance(col, str) else col
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(str(v)))])
    return F.coalesce(F.try_element_at(m, c), c)


def with_opinion_fields(df: DataFrame) -> DataFrame:
    parts = F.split(F.col("category"), "#", -1)
    return (df.withColumn("aspect_group", F.element_at(parts, 1))
            .withColumn("aspect_subgroup", F.try_element_at(parts, F.lit(2)))
            .withColumn("imp", F.col("target") != F.lit("NULL")))


def _kept(exclude: list[str] | None, keep: list[str] | None):
    k = F.lit(True)
    if exclude:
        k = k & ~F.col("aspect_group").isin(exclude)
    if keep:
        k = k & F.col("aspect_group").isin(keep)
    return k


def domain_filter(df: DataFrame, exclude: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    return df.filter(_kept(exclude, keep))


def single_group_sentences(df: DataFrame, exclude: list[str] | None = None,
                           keep: list[str] | None = None) -> DataFrame:
    """Opinion-1 rows of every sentence whose opinions all survive the domain
    filter and all share one aspect group, when the row is not neutral.

    One aggregate per sentence holds the counts, the least and greatest kept
    group and the opinion-1 rows, so the table is shuffled once, without a
    join or a window.
    """
    kept = _kept(exclude, keep)
    group = F.when(kept, F.col("aspect_group"))
    first = (F.col("opinion_num") == 1) & kept & (F.col("polarity") != "neutral")
    facts = df.groupBy("sentence_index").agg(
        # given per row (XML: size of the Opinion list) or, when absent, counted
        F.coalesce(F.max("opinion_count"), F.count(F.lit(1))).alias("_oc"),
        F.count_if(kept).alias("new_count"), F.min(group).alias("_lo"), F.max(group).alias("_hi"),
        F.collect_list(F.when(first, F.struct(*[c for c in df.columns if c != "sentence_index"]))).alias("_rows"))
    ok = facts.filter((F.col("new_count") == F.col("_oc")) & (F.col("_lo") == F.col("_hi")))
    j = ok.select("sentence_index", "_oc", "new_count", F.explode("_rows").alias("_r"))
    cols = {"sentence_index": F.col("sentence_index"), "opinion_count": F.col("_oc").alias("opinion_count")}
    return j.select(*[cols.get(c, F.col(f"_r.{c}").alias(c)) for c in df.columns], "new_count")


def gold_set(opinions: DataFrame, group_codes: dict[str, int], polarity_codes: dict[str, int],
             exclude: list[str] | None = None, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (gold rows, filtered-but-not-recoded rows)."""
    f = single_group_sentences(with_opinion_fields(opinions), exclude, keep)
    gold = (f.withColumn("polarity_code", recode("polarity", polarity_codes))
            .withColumn("aspect_code", recode("aspect_group", group_codes)))
    return gold, f


def shares(filtered: DataFrame, digits: int = 6) -> DataFrame:
    """Counts and percentage shares by polarity and by aspect group, from ONE
    pass (grouping sets), shares by a window over each (tiny) set."""
    g = (filtered.groupingSets([["polarity"], ["aspect_group"]], "polarity", "aspect_group")
         .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid")))
    g = g.select(F.when(F.col("_gid") == 1, "polarity").otherwise("aspect_group").alias("dim"),
                 F.coalesce("polarity", "aspect_group").alias("value"), "n")
    return g.select("dim", "value", "n",
                    F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("dim")), digits).alias("pct"))
