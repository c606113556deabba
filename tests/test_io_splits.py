import os

import pytest

from pyspark.sql import functions as F

from seedlabel.operators import opinions as O
from seedlabel.operators import splits as SP
from seedlabel.sources import readers, writers


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_gold_tsv_keeps_quotes(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "test.txt"), '0\t1\t0\tthe "keys" stick\n1\t3\t1\tgreat screen \n')
    rows = readers.read_gold_tsv(spark, p).orderBy("id").collect()
    assert [(r.id, r.aspect, r.polarity, r.sentence) for r in rows] == [(0, 1, 0, 'the "keys" stick'),
                                                                         (1, 3, 1, "great screen")]


def test_label_file_roundtrip(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "label.txt"), "nice food\nfood positive\nslow staff\nservice negative\n")
    out = readers.read_label_file(spark, p, ["food", "service"], ["negative", "positive"]).orderBy("record").collect()
    assert [(r.sentence, r.aspect, r.polarity) for r in out] == [("nice food", 0, 1), ("slow staff", 1, 0)]
    df = spark.createDataFrame([(0, "nice food", 0, 1)], "record long, sentence string, aspect int, polarity int")
    dst = os.path.join(tmp_dir, "export")
    writers.export_label_text(df, dst, ["food", "service"], ["negative", "positive"])
    text = "".join(open(os.path.join(dst, f)).read() for f in sorted(os.listdir(dst)) if f.startswith("part-"))
    assert text == "nice food\nfood positive\n"


def test_score_file(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "scores.txt"), "s one\n food: 0.5 service: 0.0 positive: 1.0\n")
    out = sorted((r.class_name, r.score) for r in readers.read_score_file(spark, p).collect())
    assert out == [("food", 0.5), ("positive", 1.0), ("service", 0.0)]


def test_opinion_xml(spark, tmp_dir):
    xml = """<Reviews><Review><sentences>
<sentence id="1:0"><text>Great  food, bad service!</text><Opinions>
<Opinion target="food" category="FOOD#QUALITY" polarity="positive"/>
<Opinion target="NULL" category="SERVICE#GENERAL" polarity="negative"/></Opinions></sentence>
<sentence id="1:1"><text>Tasty.</text><Opinions>
<Opinion target="NULL" category="FOOD#QUALITY" polarity="positive"/></Opinions></sentence>
</sentences></Review></Reviews>"""
    p = _write(os.path.join(tmp_dir, "x.xml"), xml)
    rows = readers.read_opinion_xml(spark, p).orderBy("sentence_index", "opinion_num").collect()
    assert [(r.sentence_index, r.opinion_num, r.opinion_count, r.category, r.target) for r in rows] == [
        (0, 1, 2, "FOOD#QUALITY", "food"), (0, 2, 2, "SERVICE#GENERAL", "NULL"), (1, 1, 1, "FOOD#QUALITY", "NULL")]
    assert rows[0].sentence == "great food , bad service !"
    gold, _ = O.gold_set(readers.read_opinion_xml(spark, p), {"FOOD": 2, "SERVICE": 4}, {"positive": 1, "negative": 0})
    assert [(r.sentence_index, r.aspect_code, r.polarity_code) for r in gold.collect()] == [(1, "2", "1")]


def test_opinion_filter_fixture(spark):
    rows = [(0, 1, 2, "positive", "t", "FOOD#A"), (0, 2, 2, "negative", "t", "FOOD#B"),
            (1, 1, 2, "positive", "t", "FOOD#A"), (1, 2, 2, "negative", "t", "SERVICE#A"),
            (2, 1, 1, "neutral", "t", "FOOD#A"),
            (3, 1, 2, "positive", "t", "FOOD#A"), (3, 2, 2, "positive", "t", "RESTAURANT#A")]
    df = spark.createDataFrame(rows, "sentence_index long, opinion_num int, opinion_count long, polarity string, "
                                     "target string, category string")
    gold, _ = O.gold_set(df, {"FOOD": 2}, {"positive": 1, "negative": 0}, exclude=["RESTAURANT"])
    assert [(r.sentence_index, r.polarity) for r in gold.collect()] == [(0, "positive")]


def test_review_csv_decode(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "r.csv"),
               'restoId,reviewScoreOverall,reviewText\n1,"7,5","b\'Lekker eten, goed!\'"\n2,8,\n')
    rows = readers.read_review_csv(spark, p).orderBy("restoId").collect()
    assert [(r.score, r.text) for r in rows] == [(7.5, "lekker eten , goed !"), (8.0, "")]


def test_results_by_folder(spark, tmp_dir):
    for m, f1 in (("A", 0.5), ("B", 0.7)):
        os.makedirs(os.path.join(tmp_dir, m))
        _write(os.path.join(tmp_dir, m, "results.csv"),
               f",timestamp,type,ablation,domain,accuracy,precision,recall,f1-score\n0,t,aspect,none,d,1,1,1,{f1}\n")
    df = readers.read_results(spark, [os.path.join(tmp_dir, m, "results.csv") for m in "AB"], "aspect", "d")
    assert sorted((r.model, r.f1_score) for r in df.collect()) == [("A", 0.5), ("B", 0.7)]


def test_global_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"))
    out = SP.global_index(df, ["k"], "i").collect()
    assert sorted((r.i, r.k) for r in out) == [(i, i) for i in range(1000)]


def test_exact_count_and_corpus_split(spark):
    df = spark.range(500).withColumn("u", SP.hash_uniform("id"))
    ex = SP.exact_count_split(df, ["id"], 37).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in ex} == {"validation": 37, "train": 463}
    cs = SP.corpus_split(df.withColumnRenamed("id", "doc_id"), "doc_id")
    c = {r.split: r["count"] for r in cs.groupBy("split").count().collect()}
    n_test = c.get("dev", 0) + c.get("weak", 0)
    assert c["train"] + n_test == 500 and c.get("dev", 0) == int(n_test * 0.05)


def test_vocab_writer_and_stamp(spark, tmp_dir):
    v = spark.createDataFrame([(0, "pasta", 3), (0, "pizza", 5), (1, "staff", 2)], "cls int, word string, freq long")
    dst = os.path.join(tmp_dir, "vocab")
    writers.write_vocabularies(v, dst, ["food", "service"])
    food = spark.read.text(os.path.join(dst, "class_name=food")).collect()
    assert [r.value for r in food] == ["pizza 5", "pasta 3"]
    r = spark.range(1).select(writers.run_stamp(writers.parse_stamp(F.lit("20240102_030405"))).alias("s")).first()
    assert r.s == "20240102_030405"


def test_embedding_cache_encodes_only_missing(spark, tmp_dir):
    import numpy as np
    from seedlabel.operators.embedding_cache import embed_with_cache
    calls = []

    def enc(texts):
        calls.append(len(texts))
        return np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

    cache = os.path.join(tmp_dir, "cache")
    a = spark.createDataFrame([(1, "a b"), (2, "ccc"), (3, "a b")], "id int, text string")
    out = {r.id: r.embedding for r in embed_with_cache(spark, a, enc, cache, "toy").collect()}
    assert out == {1: [3.0, 1.0], 2: [3.0, 0.0], 3: [3.0, 1.0]}
    b = spark.createDataFrame([(4, "ccc"), (5, "aaaa")], "id int, text string")
    out = {r.id: r.embedding for r in embed_with_cache(spark, b, enc, cache, "toy").collect()}
    assert out == {4: [3.0, 0.0], 5: [4.0, 4.0]}
    assert spark.read.parquet(cache).count() == 3      # "a b", "ccc", "aaaa"


def test_gold_tsv_and_score_text_round_trip(spark, tmp_dir):
    gold = spark.createDataFrame([(5, 1, 0, "b s"), (3, 0, 1, "a s")], "k int, aspect int, polarity int, sentence string")
    dst = os.path.join(tmp_dir, "gold")
    writers.write_gold_tsv(gold, dst, ["k"])
    back = readers.read_gold_tsv(spark, dst).orderBy("id").collect()
    assert [(r.id, r.aspect, r.polarity, r.sentence) for r in back] == [(0, 0, 1, "a s"), (1, 1, 0, "b s")]
    sc = spark.createDataFrame([(0, "s one", [0.5, 0.25])], "k int, sentence string, scores array<double>")
    sdst = os.path.join(tmp_dir, "scores")
    writers.export_score_text(sc, sdst, ["food", "service"])
    got = sorted((r.class_name, r.score) for r in readers.read_score_file(spark, sdst).collect())
    assert got == [("food", 0.5), ("service", 0.25)]


def test_predict_multiple(spark):
    import numpy as np
    from seedlabel.operators.classifier import SoftmaxHead, predict_multiple
    heads = {"asp": SoftmaxHead(np.array([[1.0, 0.0], [0.0, 0.0]]))}   # logit_0 = x, logit_1 = 0
    docs = spark.createDataFrame([(1, "aa. b"), (2, "c")], "doc_id long, text string")
    feat = lambda s: s.withColumn("x", F.array(F.length("sentence").cast("double")))
    out = [(r.doc_id, r.label, r.logit_sum) for r in predict_multiple(docs, "doc_id", "text", feat, heads, "asp", 2.0)
           .collect()]
    assert out == [(1, 0, 3.0)]


def test_label_and_score_files_of_several_split_files(spark, tmp_dir):
    """Files of unequal size, each cut into several splits: every record keeps its own lines."""
    from seedlabel.sources import readers
    want = {}
    for name, n in (("a", 400), ("b", 37), ("c", 900), ("d", 1)):
        os.makedirs(os.path.join(tmp_dir, "lab"), exist_ok=True)
        with open(os.path.join(tmp_dir, "lab", f"{name}.txt"), "w") as f:
            for i in range(n):
                a, p = ("food", "service")[i % 2], ("neg", "pos")[i % 3 == 0]
                want[f"{name} sentence {i} " + "x" * (i % 50)] = (i % 2, int(i % 3 == 0))
                f.write(f"{name} sentence {i} " + "x" * (i % 50) + f"\n{a} {p}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = readers.read_label_file(spark, os.path.join(tmp_dir, "lab"), ["food", "service"], ["neg", "pos"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.sentence: (r.aspect, r.polarity) for r in got} == want and len(got) == len(want)
    with open(os.path.join(tmp_dir, "lab", "e.txt"), "w") as f:
        f.write("a sentence without labels\n")
    with pytest.raises(ValueError, match="odd number"):
        readers.read_label_file(spark, os.path.join(tmp_dir, "lab"), ["food"], ["neg"])


def test_stream_over_a_folder_of_part_files(spark, tmp_dir):
    from seedlabel.streaming.scorer import keyword_label_counts, run_to_table, stream_table
    docs = spark.range(60).selectExpr("id AS doc_id", "concat('the ', if(id % 2 = 0, 'der', 'le'), ' x') AS text")
    docs.repartition(5).write.parquet(os.path.join(tmp_dir, "documents.parquet"))
    docs.limit(3).write.parquet(os.path.join(tmp_dir, "documents_old.parquet"))  # another table with the same prefix
    agg = keyword_label_counts(stream_table(spark, tmp_dir, "documents", max_files=2), [["der"], ["le"]])
    got = {r.label: r.n for r in spark.read.parquet(run_to_table(agg, spark)).collect()}
    assert got == {0: 30, 1: 30}
    docs.limit(0).write.parquet(os.path.join(tmp_dir, "empty.parquet"))
    agg = keyword_label_counts(stream_table(spark, tmp_dir, "empty"), [["der"], ["le"]])
    assert spark.read.parquet(run_to_table(agg, spark)).collect() == []


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    from seedlabel.session import checkpoint_dir

    class Context:
        def __init__(self, master, configured):
            self.master, self.folder, self.configured = master, None, configured

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, d):
            self.folder = d

        def getConf(self):
            return self

        def get(self, key, default=None):
            return self.configured

    class Session:
        def __init__(self, *args):
            self.sparkContext = Context(*args)
            self.conf = self.sparkContext

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session("spark://host:7077", None))
    assert checkpoint_dir(Session("spark://host:7077", "hdfs://x/ck")) == "hdfs://x/ck"
    assert checkpoint_dir(Session("local[4]", None))


def test_only_a_missing_cache_counts_as_none(spark, tmp_dir):
    from seedlabel.session import read_if_present
    assert read_if_present(spark, os.path.join(tmp_dir, "nothing")) is None
    os.makedirs(os.path.join(tmp_dir, "bad"))
    with open(os.path.join(tmp_dir, "bad", "part.parquet"), "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        read_if_present(spark, os.path.join(tmp_dir, "bad"))


def test_whole_round_trips_keep_late_sentences_and_all_words(spark, tmp_dir):
    from collections import Counter

    from seedlabel.plans import io_queries
    text = ". ".join(f"Zürich Satz {i} À {'ab' * i}" for i in range(8)) + "."
    docs = spark.createDataFrame([(1, text, "de", "web", len(text)), (2, "Été rare", "fr", "web", 8)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    want = [r.sentence for r in io_queries._labelled(spark, tmp_dir).orderBy("doc_id", "pos").collect()]
    gold = io_queries.q_gold_tsv_whole_roundtrip(spark, tmp_dir).orderBy("id").collect()
    assert len(want) > 6 and [r.sentence for r in gold] == want
    lang = {r.sentence: r.aspect for r in gold}
    count = Counter((io_queries.TQ.LANGS[lang[s]], w) for s in want for w in s.split(" "))
    got = io_queries.q_vocabulary_whole_roundtrip(spark, tmp_dir).collect()
    assert {(r.class_name, r.word): r.freq for r in got} == count and len(got) == len(count)
    assert min(count.values()) == 1 and any(not w.isascii() for _, w in count)
