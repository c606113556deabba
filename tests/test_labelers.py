import math

import pytest
from pyspark.sql import functions as F

from seedlabel.functions.bags import bag_cosine, bag_weights, sum_sq_counts
from seedlabel.functions.text import tokens
from seedlabel.operators import keywords
from seedlabel.operators import representatives as R
from seedlabel.operators import vocabulary as V


def test_keyword_labeler(spark):
    seeds = [["food", "pizza"], ["service", "staff"]]
    df = spark.createDataFrame([(1, "the pizza and the staff"), (2, "great pizza"), (3, "nothing here"),
                                (4, "Pizza is case sensitive")], "id int, line string")
    out = keywords.keyword_labels(df.withColumn("t", tokens("line")), "t", seeds)
    assert [(r.id, r.label) for r in out.collect()] == [(2, 0)]


def test_bag_cosine(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"],)], "t array<string>")
    r = df.select(sum_sq_counts("t").alias("ss"), bag_cosine("t", bag_weights(["a", "c"])).alias("c")).first()
    assert r.ss == 6
    assert r.c == pytest.approx(3 / (math.sqrt(6) * math.sqrt(2)))


def test_foreign_seed_substring(spark):
    seeds = [["windows"], ["os"]]
    df = spark.createDataFrame([(1, 0, "i like windows the most", 5)], "doc_id long, pos int, sentence string, n_words int")
    rows = R.class_rows(df.withColumn("scores", F.array(F.lit(1.0), F.lit(0.0))), seeds)
    r = rows.filter("cls = 0").first()
    assert r.foreign is True          # 'os' is a substring of 'most'
    assert r.own == [0]


def test_disjoint_vocabulary(spark):
    v = spark.createDataFrame([(0, "w", 3), (1, "w", 5), (0, "v", 2), (1, "v", 2)], "cls int, word string, freq long")
    out = sorted((r.cls, r.word, r.freq) for r in V.disjoint_vocabulary(v, 10).collect())
    assert out == [(0, "v", 2), (1, "v", 2), (1, "w", 5)]


def test_overlap_score(spark):
    sent = spark.createDataFrame([(1, ["x", "y"]), (2, ["."])], "id long, tokens array<string>")
    # contexts of x and y; class 0 gets 3 hits over both tokens, class 1 one hit
    hits = spark.createDataFrame([("<s>", "y", 0, 2), ("x", "</s>", 0, 1), ("x", "</s>", 1, 1)],
                                 "left string, right string, cls int, hits long")
    out = {r.id: r.scores for r in V.overlap_scores(sent, ["id"], hits, 2, ["."]).collect()}
    assert out[1] == [1.5, 0.5]
    assert out[2] == [0.0, 0.0]


def test_zscores_population_sd(spark):
    s = spark.createDataFrame([(i, [float(x), 1.0]) for i, x in enumerate([0, 0, 1, 3])], "id int, scores array<double>")
    z = V.zscores(s, V.class_score_stats(s))
    got = {r.id: r.z for r in z.collect()}
    assert [round(got[i][0], 6) for i in range(4)] == [-0.816497, -0.816497, 0.0, 1.632993]
    assert all(got[i][1] is None for i in range(4))        # constant column -> no z
    lab = V.zscore_labels(z, 0.5).collect()
    assert [(r.id, r.label) for r in lab] == [(3, 0)]


def _reference_greedy(sentences, scores, seeds, classes, cls, n):
    """The two loops over the FULL ranking, as plain Python (brute force)."""
    order = sorted(range(len(sentences)), key=lambda i: (-scores[i], i))
    own = seeds[cls]
    foreign = [s for c in classes if c != cls for s in seeds[c]]
    final = []
    for seed in own:
        for i in order:
            s = sentences[i]
            if f" {seed} " not in s:
                continue
            if any(f in s for f in foreign) or i in final or len(s.split()) <= 1 or s in [sentences[j] for j in final]:
                continue
            final.append(i)
            break
    for i in order:
        s = sentences[i]
        if any(f in s for f in foreign) or i in final or len(s.split()) <= 1:
            continue
        if len(final) > n:
            break
        final.append(i)
    return final


@pytest.mark.parametrize("seed_val", [0, 1, 2])
def test_representatives_equal_brute_force(spark, seed_val):
    import random
    rnd = random.Random(seed_val)
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "gg", "os", "most"]
    seeds = [["aa", "bb", "cc"], ["dd", "os"]]
    sentences = []
    for _ in range(80):
        k = rnd.randint(1, 6)
        sentences.append(" ".join(rnd.choice(words) for _ in range(k)))
    sentences += sentences[:10]   # exact duplicates
    scores = [[round(rnd.random(), 2), round(rnd.random(), 2)] for _ in sentences]
    rows = [(i, 0, s, len(s.split()), sc) for i, (s, sc) in enumerate(zip(sentences, scores))]
    df = spark.createDataFrame(rows, "doc_id long, pos int, sentence string, n_words int, scores array<double>")
    n = 3
    reps = R.representatives(R.class_rows(df, seeds), seeds, n).collect()
    for cls in (0, 1):
        got = [r.doc_id for r in sorted((r for r in reps if r.cls == cls), key=lambda r: r.pick)]
        exp = _reference_greedy(sentences, [s[cls] for s in scores], seeds, [0, 1], cls, n)
        assert got == exp


def test_representatives_two_seeds_n1(spark):
    seeds = [["aa", "bb"], ["zz"]]
    rows = [(0, 0, "x aa y", 3, [0.9, 0.0]), (1, 0, "x bb y", 3, [0.8, 0.0]), (2, 0, "x y w", 3, [0.7, 0.0])]
    df = spark.createDataFrame(rows, "doc_id long, pos int, sentence string, n_words int, scores array<double>")
    reps = [r for r in R.representatives(R.class_rows(df, seeds), seeds, 1).collect() if r.cls == 0]
    assert sorted(r.doc_id for r in reps) == [0, 1]


def test_foreign_seed_token_mode(spark):
    seeds = [["windows"], ["os"]]
    df = spark.createDataFrame([(1, 0, "i like windows the most", 5, ["i", "like", "windows", "the", "most"])],
                               "doc_id long, pos int, sentence string, n_words int, tokens array<string>")
    rows = R.class_rows(df.withColumn("scores", F.array(F.lit(1.0), F.lit(0.0))), seeds, foreign_match="token")
    assert rows.filter("cls = 0").first().foreign is False



def test_overlap_score_lexicon(spark):
    sent = spark.createDataFrame([(1, ["x", "y"])], "id long, tokens array<string>")
    hits = spark.createDataFrame([("<s>", "y", 0, 2), ("x", "</s>", 0, 1), ("x", "</s>", 1, 1)],
                                 "left string, right string, cls int, hits long")
    out = V.overlap_scores(sent, ["id"], hits, 2, ["."], lexicon=["y"]).first()
    assert out.n_cand == 1 and out.scores == [1.0, 1.0]      # only "y" is a candidate
