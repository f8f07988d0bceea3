"""Skill against the class shares, by plain arithmetic and on a model that knows something."""

import math
import random

import pytest

from marketlake.operators import models as ML
from marketlake.operators.skill import skill

SCORED = "label int, p_bsl double, p_ssl double, p_lateral double"


def test_figures_by_hand(spark):
    train = spark.createDataFrame([(0,), (0,), (1,), (2,)], "label int")
    rows = [(0, 0.7, 0.2, 0.1), (2, 0.0, 1.0, 0.0), (1, None, 0.5, 0.5), (None, 0.1, 0.1, 0.8)]
    r = skill(spark.createDataFrame(rows, SCORED), train).first()
    assert r["n"] == 2 and not r["better"]
    assert r["brier"] == pytest.approx(((0.09 + 0.04 + 0.01) / 3 + 2 / 3) / 2)
    assert r["prior_brier"] == pytest.approx(((0.25 + 0.0625 * 2) / 3 + (0.25 + 0.0625 + 0.5625) / 3) / 2)
    assert r["log_loss"] == pytest.approx((-math.log(0.7) - math.log(1e-15)) / 2)
    assert r["prior_log_loss"] == pytest.approx((math.log(2) + math.log(4)) / 2)
    none = skill(spark.createDataFrame([], SCORED), train).first()
    assert none["n"] == 0 and none["brier"] is None


def test_a_model_that_knows_something(spark):
    g = random.Random(1)
    rows = [(x := g.random(), g.random(), int(x > 0.4) + int(x > 0.7)) for _ in range(400)]
    d = ML.as_features(spark.createDataFrame(rows, "a double, b double, label int"), ["a", "b"])
    train, test = d.filter("b < 0.6"), d.filter("b >= 0.6")
    assert skill(ML.class_probabilities(ML.fit_direction(train, trees=5, depth=3), test), train).first()["better"]
