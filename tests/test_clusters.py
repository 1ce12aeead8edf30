"""Mini-batch k-means against the full fit."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans

from resona.operators import models


def _points(spark, per=400, groups=5):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(groups, 3)) * 6
    rows = [tuple(float(v) for v in c + rng.normal(size=3)) for c in centres for _ in range(per)]
    return spark.createDataFrame(rows, "a double, b double, c double").repartition(4)


def test_cost_is_near_the_full_fit(spark):
    df = _points(spark).persist()
    ready = models.vectors(df, ["a", "b", "c"])
    found = models.mini_batches(df, ["a", "b", "c"], [2, 3, 5, 8], batch=300, rounds=6, seeds=500)
    for k, (centres, cost) in found.items():
        full = min(KMeans(k=k, seed=s).fit(ready).summary.trainingCost for s in (1, 2))
        assert centres.shape == (k, 3) and cost <= 1.05 * full, (k, cost, full)
    assert models.elbow(df, ["a", "b", "c"], most=7, full=100)[0] == models.elbow(df, ["a", "b", "c"], most=7)[0]


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1.0, None)] + [(2.0, 2.0)] * 5, "a double, b double")
    (centres, cost) = models.mini_batches(df, ["a", "b"], [3])[3]
    assert cost == 0.0 and (centres == 2.0).all()
    assert models.mini_batches(df.where("false"), ["a", "b"], [3]) == {}
