"""Seed-word two-step labeler: representative sentences per class.

The reference ranks ALL sentences per class and replays two greedy loops
over that ranking.  The loops only ever look at a bounded prefix:

* seed loop -- a class with S seeds makes at most S-1 picks before any seed
  is handled, and a pick blocks one sentence and one text; so the best S
  distinct texts that carry a seed contain that seed's pick;
* fill loop -- stops once N+1 sentences are chosen; at most S of the
  eligible sentences it walks past are already chosen.

So the candidates are cut with bounded top-k windows (partial WindowGroupLimit
before the shuffle), duplicate texts are collapsed with a partial aggregate,
and only the cut (<= S*S + N+1+S rows per class) goes to a per-class
``applyInPandas`` replay.  No step sorts a whole class in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.functions.bag_udf import bag_scores
from seedlabel.operators.prototypes import top_k_per_group

REP_SCHEMA = "cls int, pick int, doc_id long, pos int, sentence string"


def _lit_array(words):
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def class_rows(scored: DataFrame, class_seeds: list[list[str]], scores_col: str = "scores",
               ids=("doc_id", "pos"), foreign_match: str = "substring", tokens_col: str = "tokens") -> DataFrame:
    """One row per (sentence, class) with the eligibility facts:

    * ``foreign`` -- a seed of another class occurs in the sentence: as a raw
      substring (``foreign_match="substring"``, the reference's behaviour,
      so ``os`` matches inside ``most``) or as a whole token (``"token"``);
    * ``n_words`` -- whitespace token count;
    * ``score`` -- the class's score to 9 places, so that equal scores tie;
    * ``own`` -- positions of the class's seeds that occur bounded by single
      spaces (``" seed "``), i.e. not at the sentence edges.

    All facts are built per sentence row with plain expressions (each
    distinct seed tested once by substring search, no lambdas) before the
    rows are split per class.
    """
    k = len(class_seeds)
    sent = F.col("sentence")
    # every distinct seed is tested once per sentence (plain substring search)
    distinct = list(dict.fromkeys(s for seeds in class_seeds for s in seeds))
    present = {s: (sent.contains(s) if foreign_match != "token" else F.array_contains(F.col(tokens_col), s))
               for s in distinct}
    base = scored.select(*ids, "sentence", "n_words", scores_col,
                         *[present[s].alias(f"_h{i}") for i, s in enumerate(distinct)])
    flag = {s: F.col(f"_h{i}") for i, s in enumerate(distinct)}
    cells = []
    for c in range(k):
        foreign = list(dict.fromkeys(f for j, seeds in enumerate(class_seeds) if j != c for f in seeds))
        fx = F.lit(False)
        for f in foreign:
            fx = fx | flag[f]
        own = F.array_compact(F.array(*[F.when(sent.contains(f" {s} "), F.lit(p))
                                        for p, s in enumerate(class_seeds[c])]))
        cells.append(F.struct(F.lit(c).alias("cls"), F.round(F.col(scores_col)[c], 9).alias("score"), fx.alias("foreign"),
                              own.alias("own")))
    return base.select(*ids, "sentence", "n_words", F.inline(F.array(*cells)))


def candidates(rows: DataFrame, class_seeds: list[list[str]], n: int) -> DataFrame:
    """Bounded candidate set for the greedy replay:
    ``(cls, kind, seed_pos, score, doc_id, pos, sentence)``."""
    s_max = max(len(s) for s in class_seeds)
    eligible = rows.filter(~F.col("foreign") & (F.col("n_words") > 1))
    seed_hits = eligible.select("cls", F.explode("own").alias("seed_pos"), "score", "doc_id", "pos", "sentence")
    # collapse duplicate texts to their best-ranked row (partial aggregate, skew-safe)
    best = (seed_hits.groupBy("cls", "seed_pos", "sentence")
            .agg(F.min(F.struct((-F.col("score")).alias("ns"), "doc_id", "pos")).alias("b"))
            .select("cls", "seed_pos", "sentence", F.col("b.ns").alias("ns"), F.col("b.doc_id").alias("doc_id"),
                    F.col("b.pos").alias("pos")))
    seed_c = top_k_per_group(best, ["cls", "seed_pos"], ["ns", "doc_id", "pos"], s_max)
    fill_c = top_k_per_group(eligible.select("cls", (-F.col("score")).alias("ns"), "doc_id", "pos", "sentence"),
                             ["cls"], ["ns", "doc_id", "pos"], n + 1 + s_max)
    return (seed_c.select("cls", F.lit("seed").alias("kind"), "seed_pos", "ns", "doc_id", "pos", "sentence")
            .unionByName(fill_c.select("cls", F.lit("fill").alias("kind"), F.lit(None).cast("int").alias("seed_pos"),
                                       "ns", "doc_id", "pos", "sentence")))


def replay_greedy(pdf: pd.DataFrame, n: int, n_seeds: dict[int, int]) -> pd.DataFrame:
    """The two loops of the reference, on one class's candidates."""
    cls = int(pdf["cls"].iloc[0])
    final, ids, texts = [], set(), set()
    seeds = pdf[pdf["kind"] == "seed"].sort_values(["seed_pos", "ns", "doc_id", "pos"])
    by_seed = {int(k): g for k, g in seeds.groupby("seed_pos", sort=True)}
    for sp in range(n_seeds.get(cls, 0)):
        g = by_seed.get(sp)
        if g is None:
            continue
        for r in g.itertuples(index=False):
            key = (int(r.doc_id), int(r.pos))
            if key in ids or r.sentence in texts:
                continue
            final.append((key, r.sentence))
            ids.add(key)
            texts.add(r.sentence)
            break
    for r in pdf[pdf["kind"] == "fill"].sort_values(["ns", "doc_id", "pos"]).itertuples(index=False):
        key = (int(r.doc_id), int(r.pos))
        if key in ids:
            continue
        if len(final) > n:
            break
        final.append((key, r.sentence))
        ids.add(key)
    return pd.DataFrame({"cls": [cls] * len(final), "pick": list(range(len(final))),
                         "doc_id": [k[0] for k, _ in final], "pos": [k[1] for k, _ in final],
                         "sentence": [s for _, s in final]}).astype({"cls": "int32", "pick": "int32",
                                                                      "doc_id": "int64", "pos": "int32"})


def representatives(rows: DataFrame, class_seeds: list[list[str]], n: int) -> DataFrame:
    """``(cls, pick, doc_id, pos, sentence)``: the chosen representatives, in pick order."""
    n_seeds = {i: len(s) for i, s in enumerate(class_seeds)}
    cand = candidates(rows, class_seeds, n)
    return cand.groupBy("cls").applyInPandas(lambda pdf: replay_greedy(pdf, n, n_seeds), REP_SCHEMA)


def nearest_to_seeds(sent: DataFrame, class_seeds: list[list[str]], min_words: int = 4,
                     tokens_col: str = "tokens", ids=("doc_id", "pos"), keep=()) -> DataFrame:
    """Top-1 sentence (with >= ``min_words`` tokens) per individual seed, by the
    cosine between the seed word and the sentence bag; ties -> lowest id.
    ``(cls, seed_pos, doc_id, pos, score)`` and the columns of ``keep``.  One
    ``min(struct)`` per seed in a single aggregate: each task keeps one row."""
    flat = [(c, p, w) for c, seeds in enumerate(class_seeds) for p, w in enumerate(seeds)]
    t = F.col(tokens_col)
    cos = bag_scores([{w: 1.0} for _, _, w in flat])(t)
    x = sent.filter(F.size(t) >= min_words).withColumn("_cos", cos)
    best = x.agg(*[F.min(F.struct((-F.col("_cos")[i]).alias("ns"), *ids, *keep)).alias(f"b{i}")
                   for i in range(len(flat))])
    rows = best.select(F.inline(F.array(*[F.struct(F.lit(c).alias("cls"), F.lit(p).alias("seed_pos"),
                                                   F.col(f"b{i}").alias("b")) for i, (c, p, _) in enumerate(flat)])))
    return rows.filter(F.col("b").isNotNull()).select(
        "cls", "seed_pos", *[F.col(f"b.{i}").alias(i) for i in (*ids, *keep)], (-F.col("b.ns")).alias("score"))


# Largest total number of (word, weight) entries across all prototype bags
# shipped to tasks as map literals.
MAX_PROTOTYPE_WORDS = 1_000_000


def _bag(text: str) -> dict[str, float]:
    out: dict[str, float] = {}
    for w in text.split():
        out[w] = out.get(w, 0.0) + 1.0
    return out


def prototype_bags(reps: list[tuple[int, str]], nearest: list[tuple[int, str]], n_classes: int,
                   max_words: int = MAX_PROTOTYPE_WORDS) -> list[list[dict[str, float]]]:
    """Per class: each representative's bag, the mean bag of the
    representatives, and the bag of each seed's nearest sentence.  Inputs are
    the (bounded) collected results of :func:`representatives` and
    :func:`nearest_to_seeds`; the total size is checked."""
    per = [[] for _ in range(n_classes)]
    for c, s in reps:
        per[c].append(_bag(s))
    out = []
    for c in range(n_classes):
        bags = list(per[c])
        if bags:
            mean: dict[str, float] = {}
            for b in bags:
                for w, v in b.items():
                    mean[w] = mean.get(w, 0.0) + v
            bags.append({w: v / len(per[c]) for w, v in mean.items()})
        bags.extend(_bag(s) for cc, s in nearest if cc == c)
        out.append(bags)
    total = sum(len(b) for bags in out for b in bags)
    if total > max_words:
        raise ValueError(f"prototype bags hold {total} entries, above the bound {max_words}")
    return out


def score_with_bags(df: DataFrame, tokens_col: str, class_bags: list[list[dict[str, float]]]) -> DataFrame:
    """``scores`` (per class: max cosine over its bags), ``label`` (first best
    class) and ``score``.  A class without bags scores 0."""
    bags, groups = [], []
    for cb in class_bags:
        groups.append(list(range(len(bags), len(bags) + len(cb))))
        bags.extend(cb)
    out = df.withColumn("scores", bag_scores(bags, groups)(F.col(tokens_col)))
    return (out.withColumn("label", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
            .withColumn("score", F.array_max("scores")))
