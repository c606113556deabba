"""Command line: label a corpus with one of the labelers and evaluate on a gold set.

    python -m seedlabel --labeler seed-sentence|seed-word|seed-word-one-step|vocabulary|keyword \\
        --corpus train.txt --gold test.txt --domain domain.json --out results/ [--ablation none]

    python -m seedlabel --compare out1/results out2/results ... --out comparison/

The second form reads the appended result tables of several runs, compares
the macro F1 of every pair of models per (domain, type) with a one-sided
pooled t-test, adjusts (Bonferroni, Holm) and writes the adjusted table and
the p-value matrix.

Outputs (under --out): labels/ (parquet), label-sentences/ (text export),
label_counts/, predictions/ (CSV), reports/ (JSON lines), results/ (appended
result rows).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from seedlabel.operators import metrics
from seedlabel.plans import workflow as WF
from seedlabel.session import get_spark
from seedlabel.sources import readers, writers


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="seedlabel")
    ap.add_argument("--labeler",
                    choices=["seed-sentence", "seed-word", "seed-word-one-step", "vocabulary", "keyword"])
    ap.add_argument("--compare", nargs="+", help="result tables written by earlier runs")
    ap.add_argument("--corpus")
    ap.add_argument("--gold")
    ap.add_argument("--domain")
    ap.add_argument("--out", required=True)
    ap.add_argument("--ablation", default="none")
    ap.add_argument("--master")
    a = ap.parse_args(argv)

    spark = get_spark(master=a.master)
    if a.compare:
        return compare(spark, a.compare, a.out.rstrip("/"))
    if not (a.labeler and a.corpus and a.domain):
        ap.error("--labeler, --corpus and --domain are required unless --compare is given")
    domain = WF.Domain.from_file(a.domain)
    lines = readers.read_corpus(spark, a.corpus)
    out = a.out.rstrip("/")

    if a.labeler == "keyword":
        labels = WF.keyword_labels(lines, domain).withColumn("polarity", F.lit(None).cast("int"))
        scorer = None
    else:
        sent = WF.corpus_sentences(lines)
        if a.labeler == "seed-sentence":
            lab = WF.seed_sentence_labeler(domain)
        elif a.labeler == "seed-word":
            lab = WF.seed_word_labeler(domain, sent, two_step=True)
        elif a.labeler == "seed-word-one-step":
            lab = WF.seed_word_labeler(domain, sent, two_step=False)
        else:
            lab = WF.VocabularyLabeler(spark, domain, sent)
        labels = lab.label() if a.labeler == "vocabulary" else lab.label(sent)
        scorer = lab
    labels = labels.drop("tokens")
    writers.write_labels(labels, f"{out}/labels")
    if "sentence" in labels.columns and a.labeler != "keyword":
        writers.export_label_text(labels, f"{out}/label-sentences", domain.aspects, domain.polarities)
    metrics.label_counts(labels, ("aspect", "polarity")).write.mode("overwrite").parquet(f"{out}/label_counts")

    if a.gold and scorer is not None:
        gold = WF.gold_sentences(readers.read_gold_tsv(spark, a.gold))
        scored = scorer.score(gold, ["id"]) if a.labeler == "vocabulary" else scorer.score(gold)
        table, report = WF.evaluate(gold, scored, domain)
        writers.write_predictions_csv(table, f"{out}/predictions")
        writers.write_run_json(report, f"{out}/reports")
        rows = writers.run_result_rows(metrics.report_summary(report, ["kind"]), a.ablation, domain.name)
        writers.append_results(rows.withColumn("model", F.lit(a.labeler)), f"{out}/results")
    return 0


def compare(spark, tables: list[str], out: str) -> int:
    from seedlabel.operators import significance as S
    res = spark.read.parquet(*tables)
    groups = ["domain", "type"]
    stats = S.model_stats(res, groups, "model", "f1_score")
    adjusted = S.adjust(S.pair_tests(stats, groups), groups)
    adjusted.write.mode("overwrite").parquet(f"{out}/pairs")
    models = sorted(r.model for r in res.select("model").distinct().collect())   # a handful of names
    (S.pvalue_matrix(adjusted, groups, models).write.mode("overwrite").option("header", "true")
     .csv(f"{out}/pvalue_matrix"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
