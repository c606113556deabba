"""Plan assertions: the physical properties the scale design relies on."""

import re

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
Q = entry.queries()


def _plan(spark, name):
    df = Q[name](spark, SMALL)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_no_cartesian_or_nested_loop(spark, name):
    p = _plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_prototype_scoring_is_map_only_with_pushdown(spark):
    p = _plan(spark, "seed_sentence_scores")
    assert "Exchange" not in p                       # no shuffle of the scored table
    assert re.search(r"PushedFilters: \[Not\(In\(vec_id", p)  # seed exclusion reaches the scan
    assert p.count("ArrowEvalPython") == 1           # one Python pass for both kinds
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in p


@pytest.mark.parametrize("name", ["document_aspects", "sentence_split", "keyword_labels", "one_step_labels"])
def test_text_scoring_only_spreads(spark, name):
    p = _plan(spark, name)
    exchanges = re.findall(r"Exchange (\w+)", p)
    assert set(exchanges) <= {"RoundRobinPartitioning"}, exchanges


@pytest.mark.parametrize("name", ["classification_report", "run_averages", "keyword_report"])
def test_reports_read_their_input_once(spark, name):
    p = _plan(spark, name)
    assert p.count("FileScan parquet") == 1
    assert p.count("ArrowEvalPython") <= 1


def test_top_k_uses_partial_group_limit(spark):
    from pyspark.sql import functions as F
    from seedlabel.operators.prototypes import top_k_per_group
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = top_k_per_group(df, ["g"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_opinion_facts_without_window(spark):
    p = _plan(spark, "opinion_gold_set")
    assert "Window" not in p


def test_gold_set_shuffles_sentences_once(spark):
    p = _plan(spark, "opinion_gold_set").split("== Initial Plan ==")[0]
    assert p.count("hashpartitioning(sentence_index") == 1


def test_seed_lookup_reads_no_vectors_before_the_fetch(spark):
    """The ids come from the class and id columns alone; the vectors from a scan with the ids pushed down."""
    from pyspark.sql import functions as F
    from seedlabel.operators.prototypes import top_k_per_group
    emb = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    ids = top_k_per_group(emb.select("vec_id", F.col("label").alias("cls")), ["cls"], ["vec_id"], 5)
    assert "ReadSchema: struct<vec_id:bigint,label:int>" in ids._jdf.queryExecution().executedPlan().toString()
    fetch = emb.filter(F.col("vec_id").isin([1, 2, 3])).select("vec_id", "embedding")
    assert "PushedFilters: [In(vec_id" in fetch._jdf.queryExecution().executedPlan().toString()


def test_word_vectors_do_not_depend_on_partitions(spark):
    from seedlabel.operators import countvec as CV
    from seedlabel.plans import learning_queries as LQ
    sent = LQ._sentences(spark, SMALL)
    seeds = LQ._seed_texts(spark)

    def labels(n):
        s = sent.repartition(n)
        vecs = CV.vectors(CV.pair_counts(s))
        scores = CV.word_scores(vecs, CV.seed_prototypes(vecs, seeds), 4)
        out = CV.classify(s, scores, [(c, -1) for c in range(4)], 4, ["doc_id", "pos"], ["gold"])
        return sorted((r.doc_id, r.pos, r.label, round(r.score, 6)) for r in out.collect())

    assert labels(2) == labels(8)
