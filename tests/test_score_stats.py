"""Class score statistics as columns against the statistics by row."""

import pytest
from pyspark.sql import functions as F

from seedlabel.operators import vocabulary as V


def test_class_score_stats_without_rows_per_class(spark):
    """Before, every sentence gave a row for each class."""
    rows = [(i, [i % 3 / 3, 0.25, None if i % 2 else i / 7.0, None]) for i in range(50)]
    scores = spark.createDataFrame(rows, "id long, scores array<double>")
    want = V.class_score_stats(scores.withColumn("scores", F.slice("scores", 1, 3)))
    got = V.class_score_stats(scores.withColumn("scores", F.slice("scores", 1, 3)), n_classes=3)
    for a, b in zip(got.orderBy("cls").collect(), want.orderBy("cls").collect(), strict=True):
        assert tuple(a) == pytest.approx(tuple(b), abs=1e-12)
    assert got.schema["cls"].dataType == want.schema["cls"].dataType
    assert "posexplode" not in got._jdf.queryExecution().toString()
    assert V.class_score_stats(scores.limit(0), n_classes=4).collect() == []
