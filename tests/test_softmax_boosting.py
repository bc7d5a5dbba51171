"""Boosting on the softmax loss: planted rules, independence of parts, and the first cut by hand."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.models.softmax_boosting import SoftmaxBoosting, binned, shares

SCHEMA = "a double, b double, noise double, y double, w double"


def planted(seed: int, n: int) -> list[tuple]:
    """Class 2 where ``a`` is missing, else by ``a`` and ``b``; numbers that aren't numbers are missing too."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = draw.choice([None, float("nan"), *[draw.random()] * 6]), draw.random()
        y = 2.0 if a is None or a != a else 1.0 if a > 0.6 and b > 0.3 else 0.0
        out.append((a, b, draw.random(), y, 1.0))
    return out


def probabilities(model, df):
    rows = model.transform(df).select("y", "prediction", vector_to_array("probability").alias("p")).collect()
    return np.array([r["p"] for r in rows]), np.array([r["prediction"] for r in rows]), np.array([r["y"] for r in rows])


def test_learns_a_planted_rule(spark):
    train, held = spark.createDataFrame(planted(1, 1500), SCHEMA), spark.createDataFrame(planted(2, 400), SCHEMA)
    model = SoftmaxBoosting(["a", "b", "noise"], "y", rounds=8, step=0.4).fit(train)
    p, guess, y = probabilities(model, held)
    assert model.numClasses == 3 and p.shape == (400, 3)
    assert np.abs(p.sum(axis=1) - 1).max() < 1e-12 and (p >= 0).all()
    assert (guess == y).mean() > 0.95 and (guess == p.argmax(axis=1)).all()


def test_parts_and_refresh_do_not_matter(spark):
    df = spark.createDataFrame(planted(3, 300), SCHEMA)
    made = [
        SoftmaxBoosting(["a", "b"], "y", rounds=4, depth=2, refresh=refresh).fit(df.repartition(parts))
        for parts, refresh in ((1, 10), (7, 10), (3, 1))
    ]
    found = [probabilities(m, df)[0] for m in made]
    assert np.array_equal(found[0], found[1])
    assert np.allclose(found[0], found[2], atol=1e-9)


def test_first_cut_by_hand(spark):
    """One round of depth one: the gradients of equal shares, each cut tried."""
    rows = [(float(i % 10), 0.0, 0.0, float(i % 10 >= 7), 1.0 + i % 2) for i in range(60)]
    model = SoftmaxBoosting(["a"], "y", classes=2, weight="w", rounds=1, depth=1, step=1.0, least_slope=0.1).fit(spark.createDataFrame(rows, SCHEMA))
    best = None
    for cut in range(9):
        parts = [[(0.5 - y, w) for a, _, _, y, w in rows if (a <= cut) == side] for side in (True, False)]
        sums = [(sum(g * w for g, w in part), sum(0.25 * w for _, w in part)) for part in parts]
        gain = sum(g * g / (h + 1) for g, h in sums)
        if best is None or gain > best[0] + 1e-9:
            best = gain, cut, [-g / (h + 1) for g, h in sums]
    left, right = best[2]
    p, _, _ = probabilities(model, spark.createDataFrame([(float(best[1]), 0, 0, 0, 1), (float(best[1] + 1), 0, 0, 0, 1)], "a double, b int, noise int, y int, w int"))
    # These are the gradients of class 1; class 0 has the opposite ones.
    want = shares(np.array([[-left, left], [-right, right]]))
    assert np.allclose(p, want, atol=1e-4)


def test_bins():
    x = np.array([np.nan, -1.0, 1.0, 1.5, 9.0])
    assert binned([x], [np.array([1.0, 2.0])])[:, 0].tolist() == [0, 1, 1, 2, 3]
    assert binned([x], [np.array([])])[:, 0].tolist() == [0, 1, 1, 1, 1]


def test_edges(spark):
    df = spark.createDataFrame(planted(4, 60), SCHEMA)
    for bad in (df.limit(0), df.withColumn("y", F.lit(3.0)), df.withColumn("y", F.lit(0.5)), df.withColumn("y", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            SoftmaxBoosting(["a"], "y", rounds=1).fit(bad)
    with pytest.raises(ValueError):
        SoftmaxBoosting(["a"], "y", bins=300)
    # Nothing to split on: everyone gets the classes' shares of the training rows, roughly; an empty frame gets no rows.
    flat = df.withColumn("a", F.lit(None).cast("double"))
    model = SoftmaxBoosting(["a"], "y", rounds=2).fit(flat)
    assert len(np.unique(probabilities(model, flat)[0], axis=0)) == 1
    assert model.transform(df.limit(0)).count() == 0
