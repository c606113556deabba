"""Every registered query runs on sf0.001; the ones with a SQL twin match it."""

import os
import re
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tests"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

SMALL = "/root/testdata/sf0.001"
# the queries of the optional subpackage have tests of their own
QUERIES = {k: v for k, v in entry.queries().items() if not re.match(r"op\d+_", k) and k != "pipeline"}
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}

EXPECTED_COLUMNS = {
    "seed_word_representatives": ["cls", "pick", "doc_id", "pos", "sentence"],
    "two_step_labels": ["doc_id", "pos", "label", "score", "gold"],
    "holm_adjusted": ["o_orderstatus", "model_a", "model_b", "t", "df", "p", "p_bonferroni", "p_holm"],
    "word_vector_labels": ["doc_id", "pos", "label", "score", "gold"],
    "hyper_search": ["trial", "gamma", "reg", "step", "val_loss", "val_accuracy"],
    "ablation_results": ["variant", "kind", "accuracy", "precision", "recall", "f1_score"],
    "class_neighbours": ["cls", "rank", "word", "similarity"],
}
REPORT = ["label", "precision", "recall", "f1", "support"]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql_twin(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE[name], SMALL)
    assert r["cols_ok"] and r["types_ok"] and r["values_ok"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert len(rows) > 0
    if name in EXPECTED_COLUMNS:
        assert df.columns == EXPECTED_COLUMNS[name]
    elif name.endswith("_report") or name in ("joint_classifier", "keyword_classifier"):
        assert df.columns[-5:] == REPORT
