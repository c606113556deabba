"""End-to-end run of every labeler on an invented mini review domain."""

import json
import os

import pytest

from seedlabel.__main__ import main
from seedlabel.plans import workflow as WF
from seedlabel.sources import readers

DOMAIN = {
    "name": "mini",
    "aspect_category_mapper": ["food", "service"],
    "aspect_seed_mapper": {"food": ["pizza", "pasta", "tasty"], "service": ["waiter", "staff", "rude "]},
    "sentiment_category_mapper": ["negative", "positive"],
    "sentiment_seed_mapper": {"positive": ["great", "good"], "negative": ["bad", "awful"]},
    "aspect_seed_sentences": {"food": ["the pizza was tasty", "great pasta here"],
                              "service": ["the waiter was rude", "staff were friendly"]},
    "sentiment_seed_sentences": {"positive": ["it was great", "really good"], "negative": ["so bad", "awful"]},
    "cat_threshold": 0.3, "pol_threshold": 0.2, "N": 2, "M": 50,
}

CORPUS = [
    "The pizza was great. The waiter was rude!",
    "we had a good pasta and the staff was good",
    "bad pizza , awful pasta ; the waiter was bad",
    "great staff . good waiter . tasty pizza",
    "the pasta was tasty and the pizza was good",
    "rude staff and a bad waiter ? never again",
    "the waiter was great and the pizza was great",
    "awful food , bad pasta",
] * 3

GOLD = [
    "0\t0\t1\tthe pizza was great",
    "1\t1\t0\tthe waiter was rude and bad",
    "2\t0\t0\tawful pasta",
    "3\t1\t1\tgood staff",
]


@pytest.fixture()
def files(tmp_dir):
    c = os.path.join(tmp_dir, "train.txt")
    open(c, "w").write("\n".join(CORPUS) + "\n")
    g = os.path.join(tmp_dir, "test.txt")
    open(g, "w").write("\n".join(GOLD) + "\n")
    d = os.path.join(tmp_dir, "domain.json")
    open(d, "w").write(json.dumps(DOMAIN))
    return c, g, d


def test_domain_from_reference_keys():
    d = WF.Domain.from_mapping(DOMAIN)
    assert d.seed_words("aspect")[1] == ["waiter", "staff", "rude"]
    assert d.seed_words("aspect", raw=True)[1][2] == "rude "
    assert d.n_representatives == 2 and d.vocab_size == 50


@pytest.mark.parametrize("labeler", ["seed-sentence", "seed-word", "seed-word-one-step", "vocabulary", "keyword"])
def test_cli_end_to_end(spark, files, tmp_dir, labeler):
    corpus, gold, domain = files
    out = os.path.join(tmp_dir, "out")
    assert main(["--labeler", labeler, "--corpus", corpus, "--gold", gold, "--domain", domain, "--out", out]) == 0
    labels = spark.read.parquet(os.path.join(out, "labels"))
    assert labels.count() > 0
    if labeler != "keyword":
        pred = spark.read.option("header", "true").csv(os.path.join(out, "predictions"))
        assert pred.count() == len(GOLD)
        res = spark.read.parquet(os.path.join(out, "results")).collect()
        assert sorted(r.type for r in res) == ["aspect", "polarity"]
        assert all(0.0 <= r.accuracy <= 1.0 for r in res)


def test_seed_sentence_labels_are_sensible(spark, files):
    corpus, gold, domain = files
    d = WF.Domain.from_file(domain)
    sent = WF.corpus_sentences(readers.read_corpus(spark, corpus))
    lab = WF.seed_sentence_labeler(d).label(sent)
    rows = {r.sentence: (r.aspect, r.polarity) for r in lab.collect()}
    assert rows.get("the pizza was great") == (0, 1)
    assert rows.get("bad pizza , awful pasta") == (0, 0)
    assert rows.get("the waiter was rude!")[0] == 1


def test_cli_compare(spark, files, tmp_dir):
    corpus, gold, domain = files
    outs = []
    for labeler in ("seed-sentence", "seed-word-one-step"):
        out = os.path.join(tmp_dir, labeler)
        for _ in range(2):   # two runs per model
            main(["--labeler", labeler, "--corpus", corpus, "--gold", gold, "--domain", domain, "--out", out])
        outs.append(os.path.join(out, "results"))
    cmp_out = os.path.join(tmp_dir, "cmp")
    assert main(["--compare", *outs, "--out", cmp_out]) == 0
    pairs = spark.read.parquet(os.path.join(cmp_out, "pairs"))
    assert pairs.count() == 2 * 4          # 2 types x (2 models)^2 ordered pairs
    m = spark.read.option("header", "true").csv(os.path.join(cmp_out, "pvalue_matrix"))
    assert m.count() == 4                  # 2 types x 2 models


def test_model_save_load(spark, tmp_dir):
    import numpy as np
    from pyspark.ml import PipelineModel
    from pyspark.sql import functions as F
    from seedlabel.operators import classifier as C
    rows = [(["pizza", "good"], 0), (["waiter", "rude"], 1), (["pasta", "tasty"], 0), (["staff", "slow"], 1)] * 5
    df = spark.createDataFrame(rows, "tokens array<string>, label int")
    model = C.keyword_text_classifier(df, "tokens", "label", num_features=64, max_iter=20)
    path = os.path.join(tmp_dir, "kw_model")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = [r.prediction for r in model.transform(df).collect()]
    b = [r.prediction for r in again.transform(df).collect()]
    assert a == b
    heads = {"h": C.SoftmaxHead(np.arange(6, dtype=float).reshape(2, 3))}
    C.save_heads(spark, heads, os.path.join(tmp_dir, "heads"))
    back = C.load_heads(spark, os.path.join(tmp_dir, "heads"))
    assert np.array_equal(back["h"].weights, heads["h"].weights)


def test_hyper_search_resumes(spark, tmp_dir):
    from seedlabel.plans import learning_queries as LQ
    path = os.path.join(tmp_dir, "trials")
    first = LQ.q_hyper_search(spark, "/root/testdata/sf0.001", trials_path=path).collect()
    again = LQ.q_hyper_search(spark, "/root/testdata/sf0.001", trials_path=path).collect()
    assert len(first) == LQ.SEARCH_TRIALS and len(again) == LQ.SEARCH_TRIALS   # nothing re-run or duplicated


def test_prepare_review_corpus(spark, tmp_dir):
    csv = os.path.join(tmp_dir, "reviews.csv")
    rows = ['restoId,reviewScoreOverall,reviewText']
    for i in range(60):
        rows.append(f'{i},"7,{i % 10}","b\'Eten was Goed nummer {i}!\'"')
    rows.append('99,8,')                           # missing text -> dropped
    open(csv, "w").write("\n".join(rows) + "\n")
    out = os.path.join(tmp_dir, "corpus")
    counts = {r.split: r["count"] for r in WF.prepare_review_corpus(spark, csv, out).collect()}
    assert sum(counts.values()) == 60
    text = spark.read.text(out).first().value
    assert text == text.lower() and " !" in text
