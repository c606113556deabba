"""Back-off substitutes and dense vectors against direct computations."""

import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seedlabel.functions.text import tokens
from seedlabel.operators import backoff as B
from seedlabel.operators import countvec as CV
from seedlabel.operators import densevec as D
from seedlabel.operators import vocabulary as V
from seedlabel.operators.packed import pack
from seedlabel.session import UNION_APART, checkpoint_dir, settings

SMALL = "/root/testdata/sf0.001"
TEXTS = ["the cat sat on the mat", "the dog sat on the rug", "a cat ran", "", "the cat sat", "mat", "dog dog dog dog"]


def _sentences(spark, texts=TEXTS):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, s string").select("id", tokens("s").alias("tokens"))


def _by_hand(texts, k, entries, d):
    exact = Counter()
    for t in texts:
        w = ["<s>", *t.split(), "</s>"]
        exact.update((w[i - 1], w[i + 1], w[i]) for i in range(1, len(w) - 1))
    left, right = Counter(), Counter()
    for (a, b, w), n in exact.items():
        left[a, w] += n
        right[b, w] += n
    kinds = Counter([w for _, w in left] + [w for _, w in right])
    c = {w: n / sum(kinds.values()) for w, n in kinds.items()}

    def lists(counts):
        groups = defaultdict(list)
        for (*key, w), n in counts.items():
            groups[tuple(key)].append((-n, w))
        out = {}
        for key, v in groups.items():
            total = -sum(n for n, _ in v)
            kept = {w: (-n - d) / total for n, w in sorted(v)[:entries]}
            out[key] = kept, 1 - sum(kept.values())
        return out

    e, lo, ro = lists(exact), lists(left), lists(right)
    result = {}
    for (a, b), (own, m) in e.items():
        (la, lm), (ra, rm) = lo[a,], ro[b,]
        p = {w: round(own.get(w, 0) + m * (la.get(w, 0) + lm * c[w] + ra.get(w, 0) + rm * c[w]) / 2, B.PLACES) for w in c}
        result[a, b] = sorted(p.items(), key=lambda x: (-x[1], x[0].encode()))[:k]
    return result


@pytest.mark.parametrize("k,entries", [(3, 2), (5, 10), (40, 3)])
def test_backoff_substitutes_by_hand(spark, k, entries):
    pos = V.token_positions(_sentences(spark), ["id"])
    got = defaultdict(list)
    for r in B.backoff_substitutes(pos, k, entries).orderBy("left", "right", "rank").collect():
        got[r.left, r.right].append((r.word, r.p))
    want = _by_hand(TEXTS, k, entries, B.DISCOUNT)
    assert set(got) == set(want)
    for key, rows in want.items():
        assert [w for w, _ in got[key]] == [w for w, _ in rows], key
        assert np.allclose([p for _, p in got[key]], [p for _, p in rows], atol=1e-11)


def test_a_rare_context_offers_words_seen_elsewhere(spark):
    pos = V.token_positions(_sentences(spark), ["id"])
    words = {r.word for r in B.backoff_substitutes(pos, 3).filter("left = 'a' AND right = 'ran'").collect()}
    assert "cat" in words and len(words) == 3


def test_backoff_of_nothing(spark):
    pos = V.token_positions(_sentences(spark, ["", " "]), ["id"])
    assert B.backoff_substitutes(pos, 3).collect() == []


def test_texts_are_read_once_by_the_keyword_classifier(spark):
    """The fit works on written features: the tokens of a text are made once."""
    from pyspark.sql import functions as F
    from seedlabel.operators import classifier as C
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def split(text):
        made.add(1)
        return text.split()

    rows = [("good food", 0), ("rude waiter", 1), ("good wine", 0), ("slow waiter", 1)] * 3
    train = spark.createDataFrame(rows, "text string, label int").select(split("text").alias("tokens"), "label")
    model = C.keyword_text_classifier(train, "tokens", "label", num_features=64, max_iter=5)
    assert made.value == len(rows)
    texts = spark.createDataFrame([(t.split(), y) for t, y in rows], "tokens array<string>, label int")
    hashed = C.hashed_texts(texts, "tokens", num_features=64)
    again = C.keyword_text_classifier(hashed, "tokens", "label", num_features=64, max_iter=5)
    assert np.allclose(model.stages[-1].coefficientMatrix.toArray(), again.stages[-1].coefficientMatrix.toArray())
    assert all(r.prediction == r.label for r in model.transform(texts).collect())


def test_keyword_labels_keep_all(spark):
    from seedlabel.operators.keywords import keyword_labels
    rows = [(0, ["a", "x"]), (1, ["b"]), (2, ["a", "b"]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    got = {r.id: r.label for r in keyword_labels(df, "tokens", [["a"], ["b"]], keep_all=True).collect()}
    assert got == {0: 0, 1: 1, 2: None, 3: None, 4: None}
    assert {r.id: r.label for r in keyword_labels(df, "tokens", [["a"], ["b"]]).collect()} == {0: 0, 1: 1}


def test_tokens_split_at_the_white_space_of_python(spark):
    chars = [c for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    rows = [(c, f"a{chr(c)}b") for c in chars]
    got = spark.createDataFrame(rows, "c int, s string").select("c", "s", tokens("s").alias("t")).collect()
    assert [r.c for r in got if r.t != r.s.split()] == []


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", tokens("text").alias("tokens"))
    return docs.select("doc_id", "tokens").limit(60)


def _matrix(spark, corpus, min_pairs):
    words, entries = D.ppmi(corpus, min_pairs)
    n, e = words.count(), entries.toPandas()
    x = np.zeros((n, n))
    x[e.i, e.j] = e.x
    return words, x


def test_dense_vectors_span_the_leading_directions(spark, corpus, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 100)
    monkeypatch.setattr(D, "MIN_BLOCKS", 3)
    words, x = _matrix(spark, corpus, 40)
    assert np.allclose(x, x.T)
    got = D.dense_vectors(corpus, dims=8, rounds=15, min_pairs=40).join(words.select("word", "idx"), "word").orderBy("idx")
    w = np.array([r.vec for r in got.collect()])
    assert w.shape == (len(x), 8)
    values = np.linalg.svd(x)[1]
    # column norms squared are singular values; the best rank-8 fit leaves the same residual
    assert np.allclose(np.sort((w * w).sum(axis=0))[::-1][:6], values[:6], rtol=0.03)
    u = w / np.sqrt((w * w).sum(axis=0))
    residual = np.linalg.norm(x - u @ (u.T @ x))
    assert residual <= np.sqrt((values[8:] ** 2).sum()) * 1.02


def test_dense_vectors_do_not_depend_on_partitions(spark, corpus):
    def run(n, parts):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            rows = D.dense_vectors(corpus.repartition(parts), dims=5, rounds=2, min_pairs=40).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        return {r.word: tuple(r.vec) for r in rows}
    assert run(2, 2) == run(8, 7)


def test_fewer_words_than_dims(spark):
    rows = D.dense_vectors(_sentences(spark, ["a b a b a b a b", "b c b c b c"]), dims=10, min_pairs=1).collect()
    assert {r.word for r in rows} == {"a", "b", "c"} and all(len(r.vec) <= 3 for r in rows)
    assert D.dense_vectors(_sentences(spark, ["", "x"]), dims=4).collect() == []


def test_pair_table_over_blocks_and_passes(spark, corpus, monkeypatch):
    monkeypatch.setattr(D, "PART_WORDS", 5)
    monkeypatch.setattr(D, "MIN_BLOCKS", 3)
    monkeypatch.setattr(D, "PASS_TOKENS", 500)
    sent = corpus.unionByName(_sentences(spark, ["a a a b", "", "a"]).select(F.lit(None).cast("long").alias("doc_id"), "tokens"))
    want, m = Counter(), Counter()
    for r in sent.collect():
        for distance in (1, 2):
            for a, b in zip(r.tokens, r.tokens[distance:]):
                want.update([(a, b), (b, a)])
    for (a, _), n in want.items():
        m[a] += n
    table = D.PairTable(pack(sent, [], block_tokens=700), 2)
    words = {r.idx: r.word for r in table.words.collect()}
    assert [words[i] for i in range(len(words))] == sorted((w for w in m if m[w] >= 2), key=lambda w: (-m[w], w.encode()))
    got = {(words[r.i], words[r.j]): r.n for r in table.pairs().collect()}
    assert got == {k: n for k, n in want.items() if min(m[k[0]], m[k[1]]) >= 2}
    assert table.total == sum(m.values()) and ("a", "a") in got


def test_a_product_sends_nothing_and_keeps_its_tasks_apart(spark, corpus, tmp_dir):
    f = D.Factorisation(D.PairTable(corpus, 40), 4)
    with settings(spark, UNION_APART):
        z = f.planned(f.start(f"{tmp_dir}/start"), np.eye(4))
        assert "Exchange" not in z._jdf.queryExecution().executedPlan().toString()
        assert z.rdd.getNumPartitions() == f.layout.blocks > 1


def test_dense_vectors_leave_one_set_of_columns(spark, corpus, tmp_dir):
    def kept(base):
        return {os.path.join(at, x) for at, _, files in os.walk(base) for x in files}
    base = checkpoint_dir(spark).removeprefix("file:")
    before = kept(base)
    vecs = D.dense_vectors(corpus, dims=8, rounds=2, min_pairs=40, place=f"{tmp_dir}/columns")
    left = [x for x in kept(base) - before if x.endswith(".parquet") and ("/columns-" in x or "-entries" in x or "numbered" in x)]
    assert left and sum(pq.read_metadata(x).num_rows for x in left) == 0
    assert spark.read.parquet(f"{tmp_dir}/columns").filter("part >= 0").select(F.sum(F.length("q"))).first()[0] == vecs.count() * 8 * 4


def test_sentences_are_scored_alike_in_shares(spark, corpus, monkeypatch):
    scores = spark.createDataFrame([("the", 1.0, {-1: 0.5, 999: 0.1}), ("a", 1.0, {-1: 0.1, 999: 0.7})],
                                   "word string, norm double, dots map<int,double>")

    def run():
        sent = pack(corpus, ["doc_id"], block_tokens=400)
        return sorted(map(tuple, CV.classify(sent, scores, [(0, -1), (1, -1)], 2, ["doc_id"], []).collect()))
    whole = run()
    monkeypatch.setattr(CV, "SHARE_TOKENS", 1000)
    assert run() == whole and len(whole) == corpus.count()


# --- word classes -------------------------------------------------------------

def _paths(tokens, model):
    """(path, probability) of every state path of a sentence."""
    from itertools import product
    states = range(len(model.start))
    for path in product(states, repeat=len(tokens)):
        p = model.start[path[0]] * model.emit[tokens[0], path[0]]
        for a, b, w in zip(path, path[1:], tokens[1:]):
            p *= model.move[a, b] * model.emit[w, b]
        yield path, p


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_by_all_paths(seed):
    from seedlabel.operators import wordclasses as H
    rng = np.random.default_rng(seed)
    model = H.start_model(6, states=3, seed=seed)
    model.emit = rng.dirichlet(np.ones(6), 3).T
    model.move = rng.dirichlet(np.ones(3), 3)
    lengths = np.array([3, 0, 1, 5, 2, 5])
    tokens = rng.integers(0, 6, lengths.sum())
    starts = np.cumsum(lengths) - lengths
    s0, mv, gamma, ll = H.expectations(tokens, starts, lengths, model)
    tags = H.viterbi(tokens, starts, lengths, model)
    want0, want_mv, want_ll = np.zeros(3), np.zeros((3, 3)), 0.0
    for a, n in zip(starts, lengths):
        if not n:
            continue
        paths = list(_paths(tokens[a:a + n], model))
        total = sum(p for _, p in paths)
        want_ll += np.log(total)
        for path, p in paths:
            want0[path[0]] += p / total
            for x, y in zip(path, path[1:]):
                want_mv[x, y] += p / total
        for t in range(n):
            assert np.allclose(gamma[a + t], [sum(p for path, p in paths if path[t] == k) / total for k in range(3)])
        assert tuple(tags[a:a + n]) == max(paths, key=lambda x: x[1])[0]
    assert np.allclose(s0, want0) and np.allclose(mv, want_mv) and np.isclose(ll, want_ll)


def test_word_classes_of_a_language_of_two_classes(spark):
    """Determiners and nouns alternate; likelihood grows and the classes split them."""
    from seedlabel.operators import wordclasses as H
    rng = np.random.default_rng(5)
    det, noun = ["the", "a", "this"], ["cat", "dog", "tree", "house", "rareword"]
    texts = [" ".join(x for _ in range(rng.integers(1, 6)) for x in (rng.choice(det), rng.choice(noun))) for _ in range(300)]
    sent = _sentences(spark, [*texts, "", "  "])
    model, symbols = H.fit(sent, states=2, head=7, tails=4, iterations=40)
    assert all(b >= a - 1e-3 for a, b in zip(model.history[1:], model.history[2:]))
    tags = {r.word: r.tag for r in H.word_tags(H.tag_counts(sent, model, symbols)).collect()}
    assert set(tags) == set(det + noun)
    assert len({tags[w] for w in det}) == 1 and {tags[w] for w in noun} == {1 - tags["the"]}
    again, _ = H.fit(sent.repartition(7), states=2, head=7, tails=4, iterations=3)
    once, _ = H.fit(sent.repartition(2), states=2, head=7, tails=4, iterations=3)
    assert np.allclose(again.emit, once.emit, atol=1e-5)


# --- hashed sentence embeddings and the classifier with a hidden layer ---------

def test_first_direction_is_found_and_removed(spark):
    from seedlabel.operators import hashed_embedding as E
    rng = np.random.default_rng(3)
    common = rng.normal(size=16)
    x = rng.normal(size=(200, 16)) * 0.3 + np.outer(rng.normal(3, 1, 200), common)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    u = E.first_direction(df.repartition(5), dims=16)
    top = np.linalg.eigh(x.T @ x)[1][:, -1]
    assert np.isclose(abs(u @ top), 1.0) and np.isclose(u @ u, 1.0)
    left = np.array([r.embedding for r in E.without_direction(df, u).orderBy("id").collect()])
    assert np.allclose(left, x - np.outer(x @ u, u)) and np.allclose(left @ u, 0)


def test_embeddings_through_the_cache(spark, tmp_dir):
    import pandas as pd
    from seedlabel.operators import embedding_cache as EC
    from seedlabel.operators import hashed_embedding as E
    sent = _sentences(spark)
    weights = E.head_weights(E.word_weights(sent), head=3)
    n = Counter(" ".join(TEXTS).split())
    total = sum(n.values())
    assert set(weights) == {"the", "dog", "cat"} and np.isclose(weights["the"], E.A / (E.A + n["the"] / total))
    encode = E.encoder(weights, 16)
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    calls = []

    def counted(s):
        return encode(s)

    EC.embed_with_cache(spark, texts.filter("id < 3"), counted, f"{tmp_dir}/c", "h")
    first = spark.read.parquet(f"{tmp_dir}/c").count()
    got = {r.id: np.array(r.embedding) for r in EC.embed_with_cache(spark, texts, counted, f"{tmp_dir}/c", "h").collect()}
    assert first == 3 and spark.read.parquet(f"{tmp_dir}/c").count() == len(set(TEXTS)) and not calls
    for i, t in enumerate(TEXTS):
        want = np.mean([E.word_signs([w], 16)[0] * weights.get(w, 1.0) / 4 for w in t.split()], axis=0) if t else np.zeros(16)
        assert np.allclose(got[i], want, atol=1e-6)
    assert np.allclose(encode(pd.Series(["", "the the"]))[0], 0)


def test_backpropagation_matches_differences():
    from seedlabel.operators import network as N
    rng = np.random.default_rng(1)
    x, y = rng.random((12, 6)), rng.integers(0, 3, 12)
    inner, outer = rng.normal(size=(4, 7)), rng.normal(size=(3, 5))
    gi, go, loss, _ = N.gradients(x, y, inner, outer)
    for w, g in ((inner, gi), (outer, go)):
        for at in np.ndindex(w.shape):
            old = w[at]
            w[at] = old + 1e-6
            up = N.gradients(x, y, inner, outer)[2]
            w[at] = old - 1e-6
            down = N.gradients(x, y, inner, outer)[2]
            w[at] = old
            assert np.isclose((up - down) / 2e-6, g[at], atol=1e-4)


def test_network_learns_and_handles_empty_texts(spark):
    from seedlabel.operators import network as N
    rows = [(w, c) for c, words in enumerate((["red", "blue"], ["one", "two"])) for w in words for _ in range(20)]
    rows += [("red one", 0), ("", 1), (None, 1)]
    df = spark.createDataFrame(rows, "s string, y int").select("y", tokens("s").alias("tokens"))
    net = N.train(N.hashed_features(df, "tokens", ["y"]), "y", 2, iters=40)
    assert net.history[-1][0] < net.history[0][0] and net.history[-1][1] > 0.9
    pred = N.predict(N.hashed_features(df, "tokens", ["y"]), net, ["y"])
    assert pred.count() == len(rows)
    assert N.train(N.hashed_features(df.limit(0), "tokens", ["y"]), "y", 2, iters=1).history == [(0.0, 0.0)]
