"""Nulls, empty and very long texts, ties and repeated rows, empty tables and
clashing column names, for every operator and pipeline stage."""

import os
import sys

import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

import corpus_pipeline  # noqa: E402
from seedlabel.llm import (decontaminate, exact_dedup, html_extract, mixing, quality, sharding, simhash,  # noqa: E402
                           substrings, token_counts, toxicity)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, digest string, fp string, place string, "
          "row string, shard string, mix_size string, mix_row string, keep_id string, `a.b` string, score string")
LONG = "alpha beta gamma delta. " * 20000


def rows():
    extra = ("x",) * 10
    return [(None, None, None, None, None, *extra), (None, "only text", "en", "s", 9, *extra),
            (1, "", "en", "s", 0, *extra), (2, None, "en", None, None, *extra), (3, " \t\n ", "en", "t", 4, *extra),
            (4, LONG, "en", "s", len(LONG), *extra), (5, "same words here", "en", "s", 15, *extra),
            (5, "same words here", "en", "s", 15, *extra), (6, "same  words\there", None, "t", 15, *extra),
            (7, "é中 \U0001f600 idiot", "fr", "t", 11, *extra)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (7, None, 1), (None, 1, 1), (1, 1, 0), (1, 0, 0)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "same words here"), (None, "é中"), (3, "beta gamma")],
                                 "item_id long, text string")


def tokenizer():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


OPERATORS = {
    "toxicity": lambda d, l, b: toxicity.scores(d, l),
    "simhash": lambda d, l, b: simhash.near_duplicates(d),
    "exact": lambda d, l, b: exact_dedup.exact_duplicates(d),
    "tokens": lambda d, l, b: token_counts.token_counts(d, tokenizer()),
    "quality": lambda d, l, b: quality.scores(d, l),
    "benchmark": lambda d, l, b: decontaminate.contamination(d, b),
    "benchmark_blocks": lambda d, l, b: decontaminate.contamination(d, b, block_words=1),
    "substrings": lambda d, l, b: substrings.remove_repeats(d),
    "sharding": lambda d, l, b: sharding.place(d, "doc_id"),
    "mixing": lambda d, l, b: mixing.mix_report(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_document(docs, labels, benchmark, name):
    out = OPERATORS[name](docs, labels, benchmark).collect()
    assert sorted((r.doc_id for r in out), key=repr) == sorted((r[0] for r in rows()), key=repr)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(docs, labels, benchmark, name):
    none = [t.filter(F.lit(False)) for t in (docs, labels, benchmark)]
    assert OPERATORS[name](*none).collect() == []
    if name in ("toxicity", "quality"):  # no labels: one score for all
        out = OPERATORS[name](docs, none[1], none[2]).collect()
        assert {r.score for r in out} == {0.5}


def by_id(out):
    return {r.doc_id: r for r in out.collect()}


def test_defined_results(docs, labels, benchmark):
    e = by_id(exact_dedup.exact_duplicates(docs))
    assert (e[5].keep_id, e[5].group_size, e[6].keep_id, e[6].kept) == (5, 3, 5, False)
    assert e[2].keep_id == 1 and e[3].keep_id == 3  # null counts as empty; a blank text is another one
    kept = [r for r in exact_dedup.exact_duplicates(docs).collect() if r.doc_id == 5]
    assert sorted(r.kept for r in kept) == [False, True]
    s = by_id(simhash.near_duplicates(docs))
    assert s[1].fingerprint == "0" * 16 and s[1].component_id == s[2].component_id == s[3].component_id == 1
    t = by_id(token_counts.token_counts(docs, tokenizer()))
    assert (t[2].n_tokens, t[2].n_bytes, t[4].over_limit) == (0, 0, True)
    c = by_id(decontaminate.contamination(docs, benchmark))
    assert (c[5].n_hit, c[5].n_items, c[2].n_words, c[7].n_hit, c[4].n_hit) == (3, 1, 0, 1, 40000)
    # all rows, in any order: two of them share the null id
    one, many = (sorted(map(repr, decontaminate.contamination(docs, benchmark, **x).collect())) for x in ({}, {"block_words": 1}))
    assert one == many and len(one) == len(rows())
    w = by_id(substrings.remove_repeats(docs))
    assert (w[4].n_words, w[4].n_removed, w[2].n_words, w[5].n_removed) == (80000, 80000, 0, 0)
    m = by_id(mixing.mix_report(docs))
    assert m[2].size == m[2].taken == 0 and all(r.taken <= 2 * r.size for r in m.values())


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, host string, blocks string"
    long_page = "<article>" + "<p>one &amp; two</p>" * 20000 + "</article>"
    rows = [(1, "http://a/", None, "x", "x", "x"), (2, None, "", "x", "x", "x"), (None, "::bad[", "<p>t", "x", "x", "x"),
            (4, "http://a/", long_page, "x", "x", "x"), (4, "http://a/", long_page, "x", "x", "x")]
    pages = spark.createDataFrame(rows, schema)
    out = html_extract.extract(pages).collect()
    assert len(out) == 5
    got = {r.page_id: r.text for r in out}
    assert got[1] == got[2] == "" and got[None] == "t" and got[4] == "\n".join(["one & two"] * 20000)
    assert html_extract.extract(pages.filter(F.lit(False))).collect() == []


def test_stages(spark, docs, labels, benchmark, tmp_dir):
    sf = f"{tmp_dir}/sf"
    labels.write.parquet(f"{sf}/labels.parquet")
    benchmark.write.parquet(f"{sf}/benchmark.parquet")
    for given in (docs, docs.filter(F.lit(False))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, sf)
            want = [c for c in docs.columns if name != "sharding" or c != "shard"]
            assert out.columns[:len(want)] == want
            if name != "sharding":
                assert out.dtypes == docs.dtypes
            assert out.count() <= 2 * given.count()
    once = corpus_pipeline.near_duplicate_stage(spark, docs, sf)
    assert sorted(r.doc_id for r in once.filter("doc_id is not null").collect()) == [1, 4, 5, 7]
    empty = f"{tmp_dir}/empty"
    labels.filter(F.lit(False)).write.parquet(f"{empty}/labels.parquet")
    benchmark.filter(F.lit(False)).write.parquet(f"{empty}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, empty).count()
