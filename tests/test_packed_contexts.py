"""Contexts sent with a list of common words, and merged buckets that are kept."""

import random

import numpy as np
import pytest

from seedlabel.operators import contexts as X
from seedlabel.operators import packed as P
from seedlabel.operators import vocabulary as V

SEEDS = [["a", "the"], ["b", "</s>"], ["nothing"]]
FILTER = [".", "x"]


def _rows(df, digits=9):
    return sorted((tuple(round(v, digits) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r)
                   for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def sent(spark):
    rnd = random.Random(4)
    words = ["a", "b", "the", "x", ".", "cat", "dog", "##s", "é", "日本", "z\U0001F600", "<s>", "</s>", "w" * 100]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 3, 5, 9]))) for _ in range(300)]
    texts += ["a"] * 40 + [f"rare{i} the rare{i + 1}" for i in range(60)]
    rows = [(None if i % 17 == 0 else i % 90, i % 3, i % 4, t.split()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, pos int, gold int, tokens array<string>").repartition(3)


@pytest.mark.parametrize("share", [1, 50, 1 << 20])
def test_common_words_change_no_result(spark, sent, share):
    packed = P.pack(sent, ["doc_id", "pos", "gold"], block_tokens=64)
    ctx = X.contexts(packed, share=share)
    assert set(ctx.common.to_pylist()) >= {"<s>", "</s>"} and (len(ctx.common) < 5) == (share == 1)
    positions = V.token_positions(sent, ["doc_id", "pos"]).filter("token is not null")
    subs = V.substitutes(V.context_fillers(positions), 30)
    assert _rows(X.substitutes(ctx, 30)) == _rows(subs.select("left", "right", "word", "n", "rank"))
    kept, seeds = ctx.written(), V.seed_table(spark, SEEDS)
    vocab = V.class_vocabulary(positions, subs.filter("rank <= 2"), seeds, FILTER)
    assert _rows(X.class_vocabulary(kept, seeds, 2, FILTER).select("cls", "word", "freq")) == _rows(
        vocab.select("cls", "word", "freq")) != []
    top = V.disjoint_vocabulary(vocab, 5)
    want = V.overlap_scores(sent, ["doc_id", "pos"], V.context_class_hit_arrays(subs.filter("rank <= 3"), top, FILTER, 3), 3, FILTER)
    got = X.overlap_scores(kept, ["doc_id", "pos"], X.class_hits(kept, top, 3, FILTER, 3), 3, FILTER, carry=["gold"]).drop("gold")
    assert _rows(got) == _rows(want)


def test_kept_buckets_are_asked_without_a_shuffle(spark, sent):
    """Before, the vocabulary and the hits each dealt all contexts anew."""
    kept = X.contexts(P.pack(sent, ["doc_id", "pos", "gold"])).written()
    top = spark.createDataFrame([(0, "cat")], "cls int, word string")
    assert "Exchange" not in X.class_hits(kept, top, 3, FILTER, 3)._jdf.queryExecution().executedPlan().toString()


def test_bucket_rows_have_no_text_of_common_words(spark, sent):
    import pyarrow as pa
    packed = P.pack(sent, ["doc_id", "pos", "gold"])
    ctx = X.contexts(packed)
    table = packed.table.select("block", "sizes", "words", "codes").toArrow()
    for batch in X._sent(iter(table.to_batches()), 2, ctx.common):
        for r in batch.to_pylist():
            text = bytes(X._apart(r["data"])[1])
            assert text.replace(b"w" * 100, b"") == b""  # longer than a word of the list may be
    for words in (pa.array([], pa.string()), pa.array(["x", "", "é", "日本"]).slice(1)):
        lengths, text = X._text_of(words)
        assert X._strings(lengths, text).to_pylist() == words.to_pylist()


def test_counts_of_more_than_31_bits_are_kept():
    import pyarrow as pa
    common = pa.array(["a", "b", "c"])
    row = lambda n: X._joined([np.array([0]), np.array([1]), np.array([2]), np.array([0, 2]), np.array(n),
                               np.zeros(0, np.int64)], np.zeros(0, np.uint8))
    big = (1 << 31) - 1
    b = X.Bucket.merged(3, common, [(7, row([big, 5])), (8, row([big, 6]))])
    c = X.Bucket.of_row(b.row().to_pylist()[0], common)
    assert b.n.tolist() == c.n.tolist() == [2 * big, 11] and c.rank.tolist() == [1, 2] and c.blocks == [7, 8]
