"""Classifiers trained on weak labels.

* :func:`train_softmax_head` -- a linear softmax head trained by full-batch
  gradient descent with momentum.  Each step is ONE distributed pass:
  every task turns its rows into a partial gradient (classes x (dim+1)
  numbers) with numpy, the partials are summed by a small aggregate, and
  the driver applies the step.  Per-row weights give the focal loss
  (``(1-p_y)^gamma``, p_y detached) and generalised cross-entropy
  (``p_y^q``), optionally times class weights; gamma = 0 is plain
  cross-entropy.
* :func:`predict_heads` -- logits, label per head (map-only pandas UDF).
* :func:`keyword_text_classifier` -- ``HashingTF`` + ``LogisticRegression``
  pipeline trained on keyword-labelled texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedlabel.functions.vectors import stack_column
from seedlabel.session import written_table

#: Buckets of the hashed texts.
TEXT_FEATURES = 1 << 18


@dataclass
class SoftmaxHead:
    weights: np.ndarray            # (k, d + 1), last column = bias
    history: list = field(default_factory=list)   # (step, loss, accuracy)

    @property
    def n_classes(self):
        return self.weights.shape[0]


def _row_weights(py: np.ndarray, y: np.ndarray, gamma: float, q: float | None, alpha: np.ndarray | None):
    w = np.ones_like(py)
    if q is not None:
        w = py ** q
    elif gamma:
        w = (1.0 - py) ** gamma
    if alpha is not None:
        w = w * alpha[y]
    return w


def _row_loss(py: np.ndarray, y: np.ndarray, gamma: float, q: float | None, alpha: np.ndarray | None):
    a = alpha[y] if alpha is not None else 1.0
    if q is not None:
        return (1.0 - py ** q) / q * a
    return -((1.0 - py) ** gamma) * np.log(np.maximum(py, 1e-300)) * a


def _softmax(X: np.ndarray, W: np.ndarray) -> np.ndarray:
    Z = X @ W[:, :-1].T + W[:, -1]
    Z -= Z.max(axis=1, keepdims=True)
    P = np.exp(Z)
    return P / P.sum(axis=1, keepdims=True)


def _partial_gradients(W: np.ndarray, gamma: float, q: float | None, alpha: np.ndarray | None):
    k, d1 = W.shape

    def run(batches):
        g = np.zeros((k, d1))
        loss = correct = n = 0.0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = stack_column(pdf["x"], d1 - 1)
            y = pdf["y"].to_numpy().astype(np.int64)
            P = _softmax(X, W)
            py = P[np.arange(len(y)), y]
            w = _row_weights(py, y, gamma, q, alpha)
            G = P.copy()
            G[np.arange(len(y)), y] -= 1.0
            G *= w[:, None]
            g[:, :-1] += G.T @ X
            g[:, -1] += G.sum(axis=0)
            loss += float(_row_loss(py, y, gamma, q, alpha).sum())
            correct += float((P.argmax(axis=1) == y).sum())
            n += len(y)
        vals = np.concatenate([g.ravel(), [loss, correct, n]])
        yield pd.DataFrame({"i": np.arange(len(vals), dtype=np.int64), "v": vals})

    return run


def evaluate_head(df: DataFrame, head: SoftmaxHead, x_col: str, y_col: str, gamma: float = 0.0,
                  q: float | None = None, alpha=None):
    """(mean loss, accuracy) of a head on a table, one distributed pass."""
    k, d1 = head.weights.shape
    data = df.select(F.col(x_col).cast("array<double>").alias("x"), F.col(y_col).cast("long").alias("y"))
    sums = _sum_partials(data, _partial_gradients(head.weights, gamma, q, alpha), k * d1 + 3)
    loss, correct, n = sums[-3:]
    mean = loss / max(n, 1.0)
    return (mean * mean if q is not None else mean), correct / max(n, 1.0)


def _sum_partials(data: DataFrame, fn, size: int) -> np.ndarray:
    rows = data.mapInPandas(fn, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def train_softmax_head(df: DataFrame, x_col: str, y_col: str, n_classes: int, gamma: float = 0.0,
                       q: float | None = None, class_weights: list[float] | None = None, reg: float = 1e-4,
                       step: float = 0.5, iters: int = 50, momentum: float = 0.9) -> SoftmaxHead:
    """Distributed full-batch gradient descent; see module doc."""
    data = (df.select(F.col(x_col).cast("array<double>").alias("x"), F.col(y_col).cast("long").alias("y"))
            .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        first = data.select(F.size("x").alias("d")).limit(1).collect()
        d = first[0]["d"] if first else 0
        k = n_classes
        alpha = np.asarray(class_weights, dtype=np.float64) if class_weights is not None else None
        W = np.zeros((k, d + 1))
        vel = np.zeros_like(W)
        head = SoftmaxHead(W)
        for it in range(iters):
            sums = _sum_partials(data, _partial_gradients(W.copy(), gamma, q, alpha), k * (d + 1) + 3)
            g = sums[:k * (d + 1)].reshape(k, d + 1)
            loss, correct, n = sums[-3:]
            n = max(n, 1.0)
            grad = g / n
            grad[:, :-1] += reg * W[:, :-1]
            vel = momentum * vel - step * grad
            W = W + vel
            mean = loss / n
            head.history.append((it, mean * mean if q is not None else mean, correct / n))
        head.weights = W
        return head
    finally:
        data.unpersist()


def predict_heads(df: DataFrame, x_col: str, heads: dict[str, SoftmaxHead]) -> DataFrame:
    """Per head: ``{name}`` label and ``{name}_logits``; map-only (the weights
    are classes x dim numbers shipped with the function)."""
    out = df
    for name, head in heads.items():
        W = head.weights
        schema = T.StructType([T.StructField("label", T.IntegerType()),
                               T.StructField("logits", T.ArrayType(T.DoubleType()))])

        def make(W=W):
            @F.pandas_udf(schema)
            def pred(x: pd.Series) -> pd.DataFrame:
                X = stack_column(x, W.shape[1] - 1)
                Z = X @ W[:, :-1].T + W[:, -1] if len(X) else np.zeros((0, W.shape[0]))
                return pd.DataFrame({"label": Z.argmax(axis=1).astype(np.int32) if len(X) else np.zeros(0, np.int32),
                                     "logits": list(Z)})
            return pred

        out = out.withColumn(f"_{name}", make()(F.col(x_col).cast("array<double>")))
        out = out.withColumn(name, F.col(f"_{name}.label")).withColumn(f"{name}_logits", F.col(f"_{name}.logits")) \
            .drop(f"_{name}")
    return out


def save_heads(spark, heads: dict[str, SoftmaxHead], path: str) -> None:
    rows = [(n, i, [float(x) for x in h.weights[i]]) for n, h in heads.items() for i in range(h.n_classes)]
    spark.createDataFrame(rows, "head string, cls int, weights array<double>").write.mode("overwrite").parquet(path)


def load_heads(spark, path: str) -> dict[str, SoftmaxHead]:
    out: dict[str, list] = {}
    for r in spark.read.parquet(path).orderBy("head", "cls").collect():
        out.setdefault(r["head"], []).append(r["weights"])
    return {n: SoftmaxHead(np.array(w)) for n, w in out.items()}


def _hashing(tokens_col: str, num_features: int) -> HashingTF:
    return HashingTF(inputCol=tokens_col, outputCol="tf", numFeatures=num_features)


def hashed_texts(df: DataFrame, tokens_col: str, num_features: int = TEXT_FEATURES) -> DataFrame:
    """The column ``tf`` that :func:`keyword_text_classifier` learns from, added."""
    return _hashing(tokens_col, num_features).transform(df)


def keyword_text_classifier(train: DataFrame, tokens_col: str, label_col: str, num_features: int = TEXT_FEATURES,
                            max_iter: int = 50, reg: float = 0.0) -> PipelineModel:
    """HashingTF over the token array + multinomial logistic regression.  Without
    a column ``tf`` (of :func:`hashed_texts`), the texts are hashed and written
    first: the fit reads them twice, for its summary and for its blocks."""
    hashing = _hashing(tokens_col, num_features)
    label = F.col(label_col).cast("double").alias(label_col)
    if "tf" in train.columns:
        rows = train.select(label, "tf")
    else:
        rows = written_table(hashing.transform(train).select(label, "tf"), "hashed-texts")
    head = LogisticRegression(featuresCol="tf", labelCol=label_col, family="multinomial", maxIter=max_iter,
                              regParam=reg, predictionCol="prediction", probabilityCol="probability",
                              rawPredictionCol="logits")
    return PipelineModel([hashing, head.fit(rows)])


def sum_and_threshold(sent_logits: DataFrame, id_col: str, logits_col: str, threshold: float) -> DataFrame:
    """Multi-label document prediction: sum the sentence logits per document
    (partial aggregate per class) and keep classes whose sum exceeds
    ``threshold``: ``(id, label, logit_sum)``."""
    e = sent_logits.select(id_col, F.posexplode(logits_col).alias("label", "x"))
    s = e.groupBy(id_col, "label").agg(F.sum("x").alias("logit_sum"))
    return s.filter(F.col("logit_sum") > threshold).select(id_col, F.col("label").cast("int"), "logit_sum")


def predict_multiple(docs: DataFrame, id_col: str, text_col: str, featurize, heads: dict[str, SoftmaxHead],
                     aspect_head: str, threshold: float = 2.0, polarity_head: str | None = None) -> DataFrame:
    """Split documents into sentences, predict every sentence, sum the aspect
    logits per document and threshold them; with a ``polarity_head`` also the
    polarity of the document, the class of its largest summed logit.
    ``featurize`` maps the sentence table to one with an ``x`` vector column."""
    from seedlabel.operators.sentences import split_sentences
    sent = featurize(split_sentences(docs, id_col, text_col))
    pred = predict_heads(sent, "x", heads)
    aspects = sum_and_threshold(pred, id_col, f"{aspect_head}_logits", threshold)
    if polarity_head is None:
        return aspects
    return aspects.join(document_polarity(pred, id_col, f"{polarity_head}_logits"), id_col)


def document_polarity(sent_logits: DataFrame, id_col: str, logits_col: str) -> DataFrame:
    """``(id, polarity)``: the class with the largest logit sum over a
    document's sentences (lowest index on ties)."""
    sums = (sent_logits.select(id_col, F.posexplode(logits_col).alias("k", "x"))
            .groupBy(id_col, "k").agg(F.sum("x").alias("s")))
    best = sums.groupBy(id_col).agg(F.max(F.struct(F.round("s", 9).alias("s"), (-F.col("k")).alias("nk"))).alias("b"))
    return best.select(id_col, (-F.col("b.nk")).cast("int").alias("polarity"))
