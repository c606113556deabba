"""Count-based word vectors: positive pointwise mutual information of a word
with the most frequent context words.

The vectors come from one table of pair counts, so they do not depend on
partitions, threads or a seed (unlike trained vectors), and any SQL engine can
recompute them.  ``dims`` (the number of context words) is a parameter of the
model, like a vector size; every word of every text takes part.

A sentence is compared with a class prototype by the mean projection of its
known words on the unit prototype.  The sentence's own length divides all
classes alike, so the best class is the one of highest cosine; only one number
per word and prototype is asked for, once per block of packed sentences.

Only pairs with a context word enter the vectors.  On packed sentences the word
counts come first (:func:`margins`), and of the pairs only those are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.operators.packed import PackedSentences, blocks_of, pack, unsqueezed
from seedlabel.session import NO_SHUFFLES_LEFT, broadcast_if_bounded, settings, shared_path, written_at

DIMS = 128
MIN_PAIRS = 10
#: Sentences are scored in up to so many shares of the blocks, one for every so many tokens.
MAX_SHARES, SHARE_TOKENS = 4, 1 << 23


def pair_counts(sent: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """``(word, context, n)``: tokens at distance one or two, in both directions."""
    t, n = F.col(tokens_col), F.size(tokens_col)

    def at(distance: int):
        size = F.greatest(n - distance, F.lit(0))
        return F.arrays_zip(F.slice(t, 1, size).alias("a"), F.slice(t, 1 + distance, size).alias("b"))

    near = sent.select(F.inline(F.concat(at(1), at(2)))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = near.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("context"), "n"),
                                        F.struct(F.col("b").alias("word"), F.col("a").alias("context"), "n"))))
    return both.groupBy("word", "context").agg(F.sum("n").alias("n"))


def margins(sent: PackedSentences) -> DataFrame:
    """``(word, m)``: the pairs of every word with any other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks_of(batch):
                place = b.place()
                near = np.minimum(place, 2) + np.minimum(np.repeat(b.sizes, b.sizes) - 1 - place, 2)
                m = np.bincount(b.codes, near, len(b.words)).astype(np.int64)
                found = np.flatnonzero(m)
                yield pa.RecordBatch.from_arrays([b.words.take(pa.array(found)), pa.array(m[found])], ["word", "m"])

    rows = sent.table.select("words", "codes", "sizes").mapInArrow(run, "word string, m long")
    return rows.groupBy("word").agg(F.sum("m").alias("m"))


def top_contexts(margin: DataFrame, dims: int = DIMS) -> DataFrame:
    """``(context, mc)``: the ``dims`` words of most pairs."""
    return margin.orderBy(F.desc("m"), "word").limit(dims).select(F.col("word").alias("context"), F.col("m").alias("mc"))


def context_pair_counts(sent: PackedSentences, contexts: DataFrame) -> DataFrame:
    """The rows of :func:`pair_counts` whose context is one of ``contexts`` (a bounded table)."""
    names = [r["context"] for r in contexts.collect()]
    if not names:
        return sent.table.sparkSession.createDataFrame([], "word string, context string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks_of(batch):
                number = pc.index_in(b.words, value_set=pa.array(names, b.words.type)).fill_null(-1).to_numpy()
                left = np.repeat(b.sizes, b.sizes) - 1 - b.place()  # tokens that follow in the sentence
                codes, keys = b.codes.astype(np.int64), []
                for distance in (1, 2):
                    first = np.flatnonzero(left >= distance)
                    one, other = codes[first], codes[first + distance]
                    for word, context in ((one, number[other]), (other, number[one])):
                        keys.append(word[context >= 0] * len(names) + context[context >= 0])
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                for at in range(0, len(key), 1 << 16):
                    k = key[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [b.words.take(pa.array(k // len(names))), pa.array((k % len(names)).astype(np.int32)),
                         pa.array(n[at:at + (1 << 16)])], ["word", "c", "n"])

    rows = sent.table.select("words", "codes", "sizes").mapInArrow(run, "word string, c int, n long")
    # dealt by word: the counts of a word meet its margin without another shuffle
    sums = rows.repartition("word").groupBy("word", "c").agg(F.sum("n").alias("n"))
    return sums.select("word", F.element_at(F.array(*map(F.lit, names)), F.col("c") + 1).alias("context"), "n")


def vectors(pairs: DataFrame, dims: int = DIMS, min_pairs: int = MIN_PAIRS, margin: DataFrame | None = None) -> DataFrame:
    """``(word, context, x)``: the non-zero PPMI values of words in ``min_pairs`` pairs or more.
    Without the ``margin`` of every word, ``pairs`` must be all pairs."""
    if margin is None:
        margin = pairs.groupBy("word").agg(F.sum("n").alias("m"))
    total = margin.agg(F.sum("m").alias("t")).scalar()
    contexts = top_contexts(margin, dims)
    p = pairs.join(broadcast_if_bounded(contexts, dims), "context").join(margin.filter(F.col("m") >= min_pairs), "word")
    x = F.ln(F.col("n").cast("double") * total / (F.col("m").cast("double") * F.col("mc").cast("double")))
    return p.select("word", "context", x.alias("x")).filter("x > 0")


def seed_prototypes(vecs: DataFrame, seeds: DataFrame, per_seed: bool = False) -> DataFrame:
    """``(cls, proto, context, x)`` of ``(cls, seed_pos, text)`` seeds: unit-length
    means of the known seed words, per class or per seed."""
    proto = F.col("seed_pos") if per_seed else F.lit(-1)
    words = seeds.select("cls", proto.alias("proto"), F.col("text").alias("word"))
    known = vecs.join(F.broadcast(words), "word")  # one row per seed word
    means = known.groupBy("cls", "proto", "context").agg(F.sum("x").alias("x"))  # the length cancels the count
    norms = means.groupBy("cls", "proto").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return means.join(norms, ["cls", "proto"]).select("cls", "proto", "context", (F.col("x") / F.col("norm")).alias("x"))


def word_scores(vecs: DataFrame, protos: DataFrame, n_protos: int, dims: int = DIMS) -> DataFrame:
    """``(word, norm, dots)``: the word's length and its projection on each
    prototype, as a map from ``cls * 1000 + proto`` (null where they share no context)."""
    rows = protos.select("context", (F.col("cls") * 1000 + F.col("proto")).alias("key"), "x").collect()  # n_protos x dims
    keys = sorted({r["key"] for r in rows})
    by_context: dict[str, list] = {}
    for r in rows:
        by_context.setdefault(r["context"], [None] * len(keys))[keys.index(r["key"])] = r["x"]
    wide = vecs.sparkSession.createDataFrame(list(by_context.items()), "context string, px array<double>")
    j = vecs.join(broadcast_if_bounded(wide, dims, row_bytes=64 + 16 * n_protos), "context", "left")
    dots = F.map_from_arrays(F.array(*[F.lit(k).cast("int") for k in keys]), F.array(*[
        F.sum(F.col("x") * F.col("px")[i]) for i in range(len(keys))])) if keys else F.lit(None).cast("map<int,double>")
    return j.groupBy("word").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), dots.alias("dots"))


def classify(sent: DataFrame | PackedSentences, scores: DataFrame, protos: list[tuple[int, int]], n_classes: int,
             ids: list[str], carry: list[str], tokens_col: str = "tokens") -> DataFrame:
    """``(*ids, *carry, label, score)`` of every sentence; without a known word class 0, score 0.
    Every block of sentences asks for its distinct words; the known ones are sent to it."""
    keep, wide = [*ids, *carry], len(protos)
    packed = sent if isinstance(sent, PackedSentences) else pack(sent, keep, tokens_col)
    shares = min(MAX_SHARES, max(1, -(-packed.n_tokens() // SHARE_TOKENS)))
    asked = scores.filter("norm is not null").select("word", F.array(*[
        F.coalesce(F.try_element_at("dots", F.lit(c * 1000 + p)), F.lit(0.0)) for c, p in protos]).alias("dots"))

    def run(base: pa.Table, answers: pa.Table) -> pa.Table:
        codes, sizes = (unsqueezed(base.column(c)[0].as_py()) for c in ("codes", "sizes"))
        at = answers.column("code").to_numpy()
        size = max(int(at.max(initial=-1)), int(codes.max(initial=-1))) + 1
        known, dots = np.zeros(size), np.zeros((size, wide))
        known[at] = 1.0
        dots[at] = answers.column("dots").combine_chunks().flatten().to_numpy().reshape(-1, wide)
        sentence, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        return pa.Table.from_arrays(
            [*(base.column(c)[0].values for c in keep), pa.array(np.bincount(sentence, known[codes], n).astype(np.int64)),
             *(pa.array(np.bincount(sentence, dots[codes, i], n)) for i in range(wide))],
            [*keep, "k", *(f"s{i}" for i in range(wide))])

    schema = ", ".join([*(f"`{c}` {packed.kinds[c]}" for c in keep), "k long", *(f"s{i} double" for i in range(wide))])

    def scored_share(share: int) -> DataFrame:
        part = replace(packed, table=packed.table.filter(F.pmod(F.xxhash64("block"), F.lit(shares)) == share))
        told = part.words().join(asked, "word").select(F.col("block").alias("of"), "code", "dots")
        blocks = part.table.select("block", *keep, "sizes", "codes")
        return blocks.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(run, schema)  # one row, and its words

    if shares == 1:
        scored = scored_share(0)
    else:  # what a share sends is gone before the next
        spark = scores.sparkSession
        path = shared_path(spark, "scored-sentences")
        with settings(spark, NO_SHUFFLES_LEFT):
            for share in range(shares):
                scored = written_at(scored_share(share), path, "append")
    # sentences of the same ids, wherever they stand, are one
    sums = scored.groupBy(*ids).agg(*[F.first(c).alias(c) for c in carry], F.sum("k").alias("k"), *[
        F.sum(f"s{i}").alias(f"s{i}") for i in range(wide)])
    mean = [F.round(F.col(f"s{i}") / F.greatest("k", F.lit(1)), 9) for i in range(wide)]
    per_class = F.array(*[F.greatest(*m) if len(m) > 1 else m[0] if m else F.lit(0.0) for m in
                          ([mean[i] for i, (c, _) in enumerate(protos) if c == k] for k in range(n_classes))])
    best = F.array_max(per_class)
    return sums.select(*ids, *carry, (F.array_position(per_class, best) - 1).cast("int").alias("label"),
                       best.alias("score"))


def similar_words(scores: DataFrame, classes: list[int], n: int) -> DataFrame:
    """``(cls, rank, word, similarity)``: the words of highest cosine with each class prototype."""
    from seedlabel.operators.prototypes import top_k_per_group
    long = scores.select("word", F.inline(F.array(*[
        F.struct(F.lit(c).alias("cls"), F.round(F.try_element_at("dots", F.lit(c * 1000 - 1)) / F.col("norm"), 6)
                 .alias("similarity")) for c in classes]))).filter("similarity is not null")
    return top_k_per_group(long, ["cls"], [F.desc("similarity"), "word"], n, rank_col="rank").select(
        "cls", "rank", "word", "similarity")
