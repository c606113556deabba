from pyspark.sql import functions as F

from seedlabel.functions.text import py_strip, sentence_pieces, tokens, word_tokens_joined
from seedlabel.operators.sentences import split_lines, split_sentences


def test_sentence_split_fixture(spark):
    df = spark.createDataFrame([(1, "Good food. Bad service! ok; fine ?  . end .")], "doc_id long, text string")
    out = [r.sentence for r in split_sentences(df).orderBy("pos").collect()]
    assert out == ["good food", "bad service", "ok", "fine", "", "end ."]


def test_split_matches_python_regex(spark):
    import re
    texts = ["A b. C d! e; f ?g\nh", "  x  ", "", "no separators here", "dots...  . ! ;", "Ünïcode. Ça va! ok"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in split_sentences(df).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.sentence))
    for i, t in enumerate(texts):
        exp = [p.strip() for p in filter(None, re.split(r'; |\. |\! |\n| \?', t.lower()))]
        assert [s for _, s in sorted(got.get(i, []))] == exp


def test_tokens_and_strip(spark):
    df = spark.createDataFrame([(" a  b\tc ", " x　")], "s string, t string")
    r = df.select(tokens("s").alias("tk"), py_strip("t").alias("st"), tokens(F.lit("")).alias("e")).first()
    assert r.tk == ["a", "b", "c"]
    assert r.st == "x"
    assert r.e == []


def test_lines_and_word_tokens(spark):
    df = spark.createDataFrame([(1, "one\ntwo words\n")], "doc_id long, text string")
    assert [r.line for r in split_lines(df).orderBy("line_no").collect()] == ["one", "two words"]
    r = spark.range(1).select(word_tokens_joined(F.lit("Hello, World!  Fine")).alias("x")).first()
    assert r.x == "hello , world ! fine"
