"""Exact quantiles by selection, and merges whose figures come from them."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from resona.operators import catalog
from resona.operators.quantiles import group_quantiles, quantile_row, quantiles

PROBABILITIES = (0.0, 0.01, 0.25, 0.5, 0.8, 1.0)


@pytest.mark.parametrize("few", [0, 100_000])
def test_quantiles_of_odd_values(spark, few):
    rng = random.Random(4)
    groups = {
        "even": [float(i % 7) for i in range(50)], "one": [3.5], "wide": [1e300, -1e300, 5e-324, 0.0, -0.0, 2.0, 1e-300], "same": [2.0] * 9,
        "spread": [10.0**k for k in range(-8, 9)], "rest": [rng.gauss(0, 1) for _ in range(301)], "ends": [math.inf, -math.inf, 1.0, 2.0, math.inf], "none": [None, None],
    }
    rows = [(g, v) for g, values in groups.items() for v in [*values, None]] + [(None, 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r.q) for r in quantiles(df, ["v"], PROBABILITIES, by=["g"], buckets=64, few=few).collect()}
    assert got.keys() == groups.keys() - {"none"}
    for g, (n, q) in got.items():
        values = sorted(groups[g])
        assert n == len(values)
        for p, x in zip(PROBABILITIES, q, strict=True):
            at = p * (n - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            want = low if low == high else low + (high - low) * (at - math.floor(at))
            assert x == want or math.isclose(x, want, rel_tol=1e-12) or math.isnan(x) and math.isnan(want)
    nan = spark.createDataFrame([(math.nan,), (1.0,), (3.0,)], "v double")
    assert quantile_row(nan, ["v"], (0.5,)).first().v == [3.0] and math.isnan(quantile_row(nan, ["v"], (1.0,)).first().v[0])
    assert quantile_row(df.limit(0), ["v"], (0.5,)).first().v is None and group_quantiles(df.limit(0), "g", ["v"], (0.5,)).count() == 0


def test_quantiles_of_a_million_distinct_values(spark):
    df = spark.range(1_000_000).select((F.xxhash64("id") / 2.0**40).alias("a"), F.exp(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 50_000).alias("b"))
    got = quantile_row(df, ["a", "b"], (0.25, 0.5, 0.999)).first()
    values = df.toPandas()
    for c in ("a", "b"):
        assert np.allclose(got[c], np.quantile(values[c], (0.25, 0.5, 0.999)), rtol=1e-12)


def test_no_value_buffer_in_the_plans(spark, sf_dir, capsys):
    from resona.plans import registry

    for name in ("agg14_agg16_agg21_val2_describe", "val4_iqr_outliers", "ml2_robust_scaling", "imp1_imp2_column_fills", "imp3_imp7_group_medians", "imp6_valid_ages"):
        registry.queries()[name](spark, sf_dir).explain()
        plan = capsys.readouterr().out.lower()
        assert "aggregate" in plan and "percentile" not in plan and "median(" not in plan


def test_large_groups_merge_alike(spark, sf_dir):
    """Groups above the bound take another way to the same medians and genres."""
    from resona.sources.fixtures import view

    tracks = view(spark, sf_dir, "tracks").limit(900).withColumn("k", F.when(F.pmod(F.hash("rec_id"), F.lit(3)) == 0, F.lit("hot")).otherwise(F.substring("track_name", 1, 7)))
    tracks = spark.createDataFrame(tracks.collect(), tracks.schema)
    key = lambda df: sorted(map(tuple, df.drop("all_sources").collect()), key=repr)
    one, two = (catalog.merge_groups(tracks, "k", ["energy", "tempo"], few=few) for few in (10_000, 5))
    assert key(one) == key(two.select(one.columns)) and one.count() == tracks.select("k").distinct().count()
