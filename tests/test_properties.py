"""Randomised property tests: many random cases per Spark job, each compared
with a direct Python computation."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedlabel.functions.bag_udf import BagScorer, bag_scores
from seedlabel.operators import metrics
from seedlabel.operators.sentences import split_sentences

ALPHABET = list("abcXYZé ") + ["; ", ". ", "! ", "\n", " ?", "  ", "\t", " ", " ", ".", "!", "?", ";"]


def _py_split(t):
    return [p.strip() for p in filter(None, re.split(r'; |\. |\! |\n| \?', t.lower()))]


def test_split_equals_python_on_random_text(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in split_sentences(df).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.sentence))
    for i, t in enumerate(texts):
        assert [s for _, s in sorted(got.get(i, []))] == _py_split(t), repr(t)


def test_bag_cosine_equals_direct(spark):
    rnd = random.Random(5)
    vocab = ["a", "b", "c", "d", "e", "f"]
    bags = [{w: float(rnd.randint(1, 3)) for w in rnd.sample(vocab, 3)} for _ in range(4)]
    sents = [[rnd.choice(vocab + ["z"]) for _ in range(rnd.randint(0, 12))] for _ in range(300)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sents)], "i int, t array<string>")
    got = {r.i: r.c for r in df.select("i", bag_scores(bags)(F.col("t")).alias("c")).collect()}
    for i, s in enumerate(sents):
        cnt = Counter(s)
        sn = math.sqrt(sum(v * v for v in cnt.values()))
        for j, b in enumerate(bags):
            qn = math.sqrt(sum(v * v for v in b.values()))
            exp = sum(cnt[w] * v for w, v in b.items()) / (sn * qn) if sn * qn > 0 else 0.0
            assert got[i][j] == pytest.approx(exp, abs=1e-12)
            assert -1.0 <= got[i][j] <= 1.0 + 1e-12


def _py_report(y, p):
    labels = sorted(set(y) | set(p))
    out = {}
    for c in labels:
        tp = sum(1 for a, b in zip(y, p) if a == c and b == c)
        pn = sum(1 for b in p if b == c)
        sup = sum(1 for a in y if a == c)
        pr = tp / pn if pn else 0.0
        rc = tp / sup if sup else 0.0
        f1 = 2 * tp / (sup + pn) if sup + pn else 0.0
        out[str(c)] = (pr, rc, f1, sup)
    macro = tuple(np.mean([out[str(c)][k] for c in labels]) for k in range(3))
    return out, macro, sum(a == b for a, b in zip(y, p)) / len(y)


def test_report_equals_direct(spark):
    rnd = random.Random(11)
    rows = []
    cases = []
    for g in range(30):
        n = rnd.randint(1, 40)
        y = [rnd.randint(0, 4) for _ in range(n)]
        p = [rnd.choice([a, rnd.randint(0, 5)]) for a in y]
        cases.append((y, p))
        rows += [(g, a, b) for a, b in zip(y, p)]
    rep = metrics.classification_report(spark.createDataFrame(rows, "g int, a int, p int"), "a", "p", ["g"]).collect()
    by = {}
    for r in rep:
        by.setdefault(r.g, {})[r.label] = r
    for g, (y, p) in enumerate(cases):
        per, macro, acc = _py_report(y, p)
        for lab, (pr, rc, f1, sup) in per.items():
            r = by[g][lab]
            assert (r.precision, r.recall, r.f1, r.support) == (round(pr, 6), round(rc, 6), round(f1, 6), sup)
        assert by[g]["accuracy"].f1 == round(acc, 6)
        assert by[g]["macro avg"].f1 == pytest.approx(round(macro[2], 6), abs=1e-9)
        assert sum(by[g][lab].support for lab in per) == len(y)


def test_holm_is_monotone_and_above_raw(spark):
    from seedlabel.operators.significance import adjust
    rnd = random.Random(2)
    rows = [(f"m{i}", f"x{i}", rnd.uniform(-4, 4), 20) for i in range(40)]
    out = adjust(spark.createDataFrame(rows, "model_a string, model_b string, t double, df long"), [],
                 n_models=9).collect()
    pairs = sorted((r.p, r.p_holm) for r in out)
    for (p0, h0), (p1, h1) in zip(pairs, pairs[1:]):
        assert h1 >= h0 - 1e-15
    assert all(h >= p - 1e-15 and h <= 1.0 for p, h in pairs)


def test_bag_scorer_grouping_is_max():
    s = BagScorer([{"a": 1.0}, {"b": 1.0}, {"a": 1.0, "b": 1.0}], groups=[[0, 1], [2]])
    cos = s.cosines([["a", "a", "b"]])
    g = s.grouped(cos)
    assert g[0, 0] == pytest.approx(max(cos[0, 0], cos[0, 1]))
    assert g[0, 1] == pytest.approx(cos[0, 2])
