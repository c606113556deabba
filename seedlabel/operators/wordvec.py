"""Word-vector cosine classifier: Word2Vec fitted on the corpus, class
prototypes = mean vectors of seed words (or of seed sentences), sentence
vector = mean of its word vectors, label = class of the most similar
prototype.  An all-unknown sentence gets the zero vector, cosine 0 with every
prototype, hence class 0."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.session import broadcast_if_bounded
from seedlabel.operators.prototypes import PrototypeSet, collect_prototypes, mean_vectors, score_with_prototypes


def fit_word2vec(sent: DataFrame, tokens_col: str = "tokens", vector_size: int = 100, window: int = 5,
                 min_count: int = 5, seed: int = 42, max_iter: int = 1, partitions: int = 8) -> Word2VecModel:
    """Fit on all token arrays.  ``partitions`` is a parameter of the model:
    its tasks train apart and are averaged, so it changes the vectors, and
    must not follow the cluster's size.  The sentences are dealt to the tasks
    by content, in a fixed order."""
    data = sent.select(F.col(tokens_col).alias("tokens"))
    data = data.repartition(partitions, F.xxhash64("tokens")).sortWithinPartitions(F.xxhash64("tokens"), "tokens")
    w2v = Word2Vec(vectorSize=vector_size, windowSize=window, minCount=min_count, seed=seed, maxIter=max_iter,
                   numPartitions=partitions, inputCol="tokens", outputCol="vec")
    return w2v.fit(data)


def seed_prototypes(model: Word2VecModel, seed_texts: DataFrame, per_seed: bool = False,
                    name: str = "w2v") -> PrototypeSet:
    """``seed_texts``: ``(cls, seed_pos, text)``.  One prototype per class
    (mean over all its in-vocabulary seed words) or, with ``per_seed``, one
    per seed text (mean over that text's words)."""
    vecs = model.getVectors().select(F.col("word"), vector_to_array("vector").alias("v"))
    words = seed_texts.select("cls", "seed_pos", F.explode(F.split(F.trim("text"), "\\s+")).alias("word"))
    known = words.join(vecs, "word")
    keys = ["cls", "seed_pos"] if per_seed else ["cls"]
    means = mean_vectors(known, keys, "v")
    protos = means.select(F.col("cls").cast("int").alias("cls"),
                          (F.col("seed_pos") if per_seed else F.lit(-1)).cast("long").alias("proto_id"), "vec")
    return collect_prototypes(name, protos)


def sentence_vectors(model: Word2VecModel, sent: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    out = model.setInputCol(tokens_col).setOutputCol("_wv").transform(sent)
    return out.withColumn("wv", vector_to_array("_wv")).drop("_wv")


def classify(model: Word2VecModel, sent: DataFrame, protos: PrototypeSet, tokens_col: str = "tokens",
             label_col: str = "label") -> DataFrame:
    scored = score_with_prototypes(sentence_vectors(model, sent, tokens_col), "wv", [protos])
    return scored.withColumnRenamed(protos.name, label_col).withColumnRenamed(f"{protos.name}_score", "score")


def similar_words(model: Word2VecModel, protos: PrototypeSet, n: int = 10) -> list[tuple[int, int, str, float]]:
    """The ``n`` vocabulary words most similar to each prototype of a set:
    ``(cls, rank, word, similarity)``.  One lookup per prototype (a bounded
    number) against the model's vectors."""
    from pyspark.ml.linalg import Vectors
    out = []
    for row, cls in zip(protos.matrix, protos.classes):
        syn = model.findSynonymsArray(Vectors.dense(row.tolist()), n)
        out += [(int(cls), i + 1, w, float(s)) for i, (w, s) in enumerate(syn)]
    return out
