"""Texts packed from their bytes against the sentence expressions."""

import random
import subprocess
import sys

from seedlabel.functions.text import tokens
from seedlabel.operators import packed as P
from seedlabel.operators.sentences import split_sentences


def _rows(df):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()), key=repr)


def _sentences(packed):
    back = []
    for r in packed.table.collect():
        codes, at = P.unsqueezed(bytes(r.codes)), 0
        for d, p, n in zip(r.doc_id, r.pos, P.unsqueezed(bytes(r.sizes))):
            back.append((d, p, tuple(r.words[c] for c in codes[at:at + n])))
            at += n
    return sorted(back, key=repr)


def test_texts_are_cut_as_by_the_sentence_expressions(spark):
    """Before, every sentence was a row of the JVM with patterns of its own."""
    rnd = random.Random(5)
    signs = [*"aB;.!?éÀ日 \n \n\t\x0b\x0c\r\x1c\x1f\x85\xa0", " ", " ", " ", "​", " ", " ", " ",
             "　", "、", "\U0001F600", "İ", "; ", ". ", "! ", " ?", "; ?", " ? ?"]
    rows = [(None if i % 9 == 0 else i % 70, "".join(rnd.choice(signs) for _ in range(rnd.choice([0, 1, 2, 4, 9, 30]))))
            for i in range(600)] + [(1, None), (2, ""), (3, " "), (4, "Σ ΣΑΣ. x"), (5, "a" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = split_sentences(docs).select("doc_id", "pos", tokens("sentence").alias("tokens"))
    assert _sentences(P.pack_texts(docs, ["doc_id"], block_tokens=64)) == _rows(want)


def test_no_sentence_is_a_row_before_it_is_packed(spark, tmp_path, monkeypatch):
    """Before, the plan exploded the sentences of a text."""
    from seedlabel.plans import vocab_queries as VQ
    spark.createDataFrame([(1, "en", "A b. c"), (2, "xx", "d; e ?f")], "doc_id long, lang string, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    plans, write = [], P.written_at
    monkeypatch.setattr(P, "written_at", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().toString()), write(df, *a, **k))[1])
    run = VQ.VocabRun(spark, str(tmp_path))
    assert "Generate" not in plans[0] and run.sent.n_tokens() == 6


def test_workers_give_memory_back():
    """Before, a worker kept over 200 MB between its tasks."""
    run = """
import re, numpy as np, pyarrow as pa
from seedlabel.operators.packed import lean_memory
lean_memory()
used = lambda: int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
before = used()
for size in (8, 12, 16, 24, 30):
    held = [np.ones(size << 17) for _ in range(10)], [pa.array(np.arange(size << 17)).cast(pa.string()) for _ in range(2)]
    small = [bytes(100) for _ in range(1000)]
    del held
assert pa.default_memory_pool().backend_name == "system"
assert used() - before < 40, (before, used())
"""
    subprocess.run([sys.executable, "-c", run], check=True, cwd=P.__file__.split("/seedlabel/")[0])
