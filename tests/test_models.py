"""Models that have nothing to learn from."""

from pyspark.ml.linalg import Vectors

from marketlake.operators import models as ML


def rows(spark, labels):
    return spark.createDataFrame([(k, y, Vectors.dense(float(k), float(k % 2))) for k, y in enumerate(labels)], ["id", "label", "features"])


def test_hold_without_training_rows(spark):
    d = rows(spark, [0, 1, 1, 0])
    model = ML.fit_hold(d.filter("id < 0"), trees=2, depth=2)
    assert [r["p_hold"] for r in ML.hold_probability(model, d).collect()] == [0.5] * 4


def test_hold_of_both_classes(spark):
    d = rows(spark, [0, 1] * 10)
    p = {r["id"]: r["p_hold"] for r in ML.hold_probability(ML.fit_hold(d, trees=2, depth=2), d).collect()}
    assert max(v for k, v in p.items() if k % 2 == 0) < 0.5 < min(v for k, v in p.items() if k % 2)
