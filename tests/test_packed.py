"""Packed sentences against the plain operators, with blocks and buckets of a few tokens."""

import random

import pytest
from pyspark.sql import functions as F

from seedlabel.operators import contexts as X
from seedlabel.operators import countvec as CV
from seedlabel.operators import packed as P
from seedlabel.operators import vocabulary as V

SMALL = "/root/testdata/sf0.001"
SEEDS = [["a", "the"], ["b", "</s>"], ["nothing"]]
FILTER = [".", "x"]


def _texts():
    rnd = random.Random(3)
    words = ["a", "b", "the", "x", ".", "cat", "dog", "##s", "é", "日本", "z\U0001F600", "<s>", "</s>"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 1, 2, 3, 5, 9]))) for _ in range(300)]
    return [*texts, "", *["a"] * 40, " ".join(["long"] * 50)]


@pytest.fixture(scope="module")
def sent(spark):
    # ids that repeat and are null
    rows = [(None if i % 17 == 0 else i % 90, i % 3, i % 4, t.split()) for i, t in enumerate(_texts())]
    return spark.createDataFrame(rows, "doc_id long, pos int, gold int, tokens array<string>").repartition(3)


@pytest.fixture(scope="module")
def packed(sent):
    return P.pack(sent, ["doc_id", "pos", "gold"], block_tokens=64)


@pytest.fixture(scope="module")
def plain(sent):
    positions = V.token_positions(sent, ["doc_id", "pos"]).filter("token is not null")  # none in an empty sentence
    return positions, V.substitutes(V.context_fillers(positions), 30)


def _rows(df, digits=9):
    return sorted((tuple(round(v, digits) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r)
                   for r in df.collect()), key=repr)


def test_blocks_hold_every_sentence(packed, sent):
    assert packed.table.count() > 5 and packed.n_tokens() == sum(len(t.split()) for t in _texts())
    back = []
    for r in packed.table.collect():
        codes, at = P.unsqueezed(bytes(r.codes)), 0
        assert r.words == sorted(r.words, key=str.encode)
        for d, p, g, n in zip(r.doc_id, r.pos, r.gold, P.unsqueezed(bytes(r.sizes))):
            back.append((d, p, g, tuple(r.words[c] for c in codes[at:at + n])))
            at += n
    assert sorted(back, key=repr) == _rows(sent)


@pytest.mark.parametrize("k", [1, 3, 30])
def test_substitutes(packed, plain, k):
    want = plain[1].filter(F.col("rank") <= k).select("left", "right", "word", "n", "rank")
    assert _rows(X.substitutes(X.contexts(packed), k)) == _rows(want)


def test_class_vocabulary(spark, packed, plain):
    seeds = V.seed_table(spark, SEEDS)
    want = V.class_vocabulary(plain[0], plain[1].filter("rank <= 2"), seeds, FILTER)
    got = X.class_vocabulary(X.contexts(packed), seeds, 2, FILTER)
    assert _rows(got.select("cls", "word", "freq")) == _rows(want.select("cls", "word", "freq")) != []


@pytest.mark.parametrize("lexicon", [None, ["a", "cat", "dog"], "table", "empty"])
def test_overlap_scores(spark, sent, packed, plain, lexicon):
    if isinstance(lexicon, str):
        lexicon = spark.createDataFrame([(w,) for w in ["cat", "a", "a", "unseen"] if lexicon == "table"], "word string")
    seeds = V.seed_table(spark, SEEDS)
    vocab = V.disjoint_vocabulary(V.class_vocabulary(plain[0], plain[1], seeds, FILTER), 5)
    hits = V.context_class_hit_arrays(plain[1].filter("rank <= 3"), vocab, FILTER, 3)
    want = V.overlap_scores(sent, ["doc_id", "pos"], hits, 3, FILTER, lexicon=lexicon)
    ctx = X.contexts(packed)
    got = X.overlap_scores(ctx, ["doc_id", "pos"], X.class_hits(ctx, vocab, 3, FILTER, 3), 3, FILTER, lexicon=lexicon,
                           carry=["gold"]).drop("gold")
    assert _rows(got) == _rows(want)


def test_context_pairs_and_labels(spark, sent, packed):
    pairs = CV.pair_counts(sent)
    margin = CV.margins(packed)
    assert _rows(margin) == _rows(pairs.groupBy("word").agg(F.sum("n").alias("m")))
    top = CV.top_contexts(margin, 4)
    few = CV.context_pair_counts(packed, top)
    assert _rows(few) == _rows(pairs.join(top, "context").select("word", "context", "n"))
    vecs = CV.vectors(few, 4, 10, margin)
    assert _rows(vecs) == _rows(CV.vectors(pairs, 4, 10))
    seeds = spark.createDataFrame([(0, 0, "a"), (0, 1, "cat"), (1, 0, "b"), (1, 1, "gone")], "cls int, seed_pos int, text string")
    keys = [(0, 0), (0, 1), (1, 0), (1, 1)]
    scores = CV.word_scores(vecs, CV.seed_prototypes(vecs, seeds, True), 4, 4)
    known = {r.word: r.dots for r in scores.collect()}
    sums = {}
    for r in sent.collect():
        k, s = sums.setdefault((r.doc_id, r.pos), [0, [0.0] * 4])
        for t in r.tokens:
            if t in known:
                k += 1
                s = [a + ((known[t] or {}).get(c * 1000 + p) or 0.0) for a, (c, p) in zip(s, keys)]
        sums[r.doc_id, r.pos] = [k, s]
    for r in CV.classify(packed, scores, keys, 2, ["doc_id", "pos"], ["gold"]).collect():
        k, s = sums.pop((r.doc_id, r.pos))
        best = [round(max(s[:2]) / max(k, 1), 9), round(max(s[2:]) / max(k, 1), 9)]
        assert r.score == pytest.approx(max(best), abs=2e-9)
        assert best[r.label] == pytest.approx(max(best), abs=2e-9)
    assert not sums


def test_nothing_to_pack(spark):
    none = P.pack(spark.createDataFrame([], "id long, tokens array<string>"), ["id"])
    ctx = X.contexts(none)
    assert X.substitutes(ctx, 3).collect() == [] and CV.margins(none).collect() == []
    empty = P.pack(spark.createDataFrame([(1, []), (2, None)], "id long, tokens array<string>"), ["id"])
    vocab = spark.createDataFrame([], "cls int, word string")
    ctx = X.contexts(empty)
    out = X.overlap_scores(ctx, ["id"], X.class_hits(ctx, vocab, 3, [], 2), 2, [])
    assert _rows(out) == [(1, 0, (0.0, 0.0)), (2, 0, (0.0, 0.0))]


@pytest.mark.parametrize("name,by", [("substitute_topk", "left"), ("class_vocabulary", "left"), ("overlap_scores", "left"),
                                     ("zscore_forced", "left"), ("word_vector_labels", "word_of_token")])
def test_no_row_per_token_is_shuffled(spark, name, by):
    """Before, every token was dealt by its context, and every token by its word and by its sentence."""
    import __spark_entry__ as entry
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().toString()
    assert f"hashpartitioning({by}" not in plan
    assert "Generate explode(tokens" not in plan and "arrays_zip" not in plan
