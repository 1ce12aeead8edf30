"""Fits on distinct rows with their numbers of copies, against fits on all rows."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from resona.operators import models


def _copies(spark, n=4000, seed=5):
    rng = np.random.default_rng(seed)
    kinds = np.round(rng.random((40, 2)), 2)
    rows = [(float(x), float(y), float(x + rng.normal() * 0.3 > 0.5), float(round(10 * x - y))) for x, y in kinds[rng.integers(0, 40, n)]]
    return spark.createDataFrame([*rows, (None, 0.5, 1.0, 1.0)], "x double, y double, label double, level double").repartition(4)


def test_rows_are_counted(spark):
    df = _copies(spark)
    points = models.counted(df, ["x", "y"], many=0)
    assert points.count() == df.na.drop().select("x", "y").distinct().count() <= 40
    assert points.agg(F.sum("_n")).first()[0] == 4000
    assert models.counted(df, ["x", "y"]).agg(F.count("*"), F.max("_n")).first() == (4000, 1)
    assert models.counted(df.where("false"), ["x", "y"], many=0).count() == 0


def test_counted_forests_answer_as_those_on_all_rows(spark, tmp_path):
    df, seen = _copies(spark), {}
    for way, many in (("counted", 0), ("rows", None)):
        chosen = models.forest_classifier(df, ["x", "y"], "label", trees=12, depth=4, many=many)
        level = models.forest_regressor(df, ["x", "y"], "level", trees=12, depth=4, many=many)
        found = models.answered(df, ["x", "y"], [chosen, level], ["probability", "prediction", "expected"], many=many)
        p = vector_to_array("probability")[1]
        assert found.count() == 4000 and found.where((p > 0.5) != (F.col("prediction") == 1)).count() == 0
        seen[way] = {(r.x, r.y): (r.p, r.expected) for r in found.select("x", "y", p.alias("p"), "expected").distinct().collect()}
        shares = {r.feature: r.importance for r in models.importances(chosen, ["x", "y"], spark).collect()}
        assert abs(sum(shares.values()) - 1) < 1e-9 and shares["x"] > shares["y"]
        if way == "counted":
            again = models.forest_classifier(df.repartition(3), ["x", "y"], "label", trees=12, depth=4, many=0)
            assert abs(again.transform(df.na.drop()).agg(F.sum(p)).first()[0] - chosen.transform(df.na.drop()).agg(F.sum(p)).first()[0]) < 1e-6
            chosen.write().save(f"{tmp_path}/forest")
            loaded = PipelineModel.load(f"{tmp_path}/forest")
            assert loaded.transform(df.na.drop()).where("prediction = 1").count() == chosen.transform(df.na.drop()).where("prediction = 1").count()
    gaps = np.array([np.subtract(seen["counted"][k], seen["rows"][k]) for k in seen["rows"]])
    assert set(seen["counted"]) == set(seen["rows"]) and (np.abs(gaps).mean(0) < (0.06, 0.35)).all(), np.abs(gaps).mean(0)


def test_clusters_of_counted_rows_cost_as_those_of_all_rows(spark):
    df = _copies(spark).na.drop()
    ready, points = models.vectors(df, ["x", "y"]), models.counted(df, ["x", "y"], many=0)
    assert points.count() <= 40
    model, labelled = models.cluster(df, ["x", "y"], 3, many=0)
    assert labelled.count() == 4000
    full = min(KMeans(k=3, seed=s).fit(ready).summary.trainingCost for s in (1, 2, 3))
    found = min(models.centred(points, ["x", "y"], 3, s).summary.trainingCost for s in (1, 2, 3))
    assert abs(found - full) <= 0.1 * full, (found, full)
    assert model.summary.predictions.count() == points.count()
    own = model.transform(ready).withColumnRenamed("prediction", "cluster")
    assert abs(models.silhouette(own) - models.silhouette(labelled)) < 1e-9
