"""What the id mapping and the platform prediction shuffle."""

from __future__ import annotations

import hashlib

import numpy as np

from resona.operators import catalog, insights, models


def test_ids_are_shuffled_as_bytes(spark, capfd):
    df = spark.createDataFrame([("k", "s", "r1"), ("k", "t", "r0"), (None, "s", "r2")], "k string, source_dataset string, rec_id string")
    found = catalog.id_mapping(df, "k")
    found.explain()
    assert "unhex(sha2(" in capfd.readouterr().out
    assert sorted(((r.master_id or "", [tuple(x) for x in r.records]) for r in found.collect())) == [("", [("s", "r2")]), (hashlib.sha256(b"k").hexdigest(), [("s", "r1"), ("t", "r0")])]


def test_prediction_shuffles_one_row_per_song(spark, capfd):
    songs = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, None), ("b", None, 1.0), ("c", None, None)], "rec_id string, x double, y double")
    affinity = spark.createDataFrame([("p", "x", 0.5), ("p", "y", -1.0), ("q", "x", 1.0)], "platform string, feature string, r double")
    found = insights.predicted_platforms(songs, affinity, ["x", "y"])
    found.explain()
    assert capfd.readouterr().out.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect())) == [("a", "p", 0.0, 2), ("a", "q", 4.0, 1), ("b", "p", -1.0, 1), ("b", "q", None, 2), ("c", "p", None, 1), ("c", "q", None, 2)]


def test_merges_shuffle_rows_and_count_keys_of_crowded_buckets_alone(spark, capfd, monkeypatch):
    rows = [(f"k{i % 40}", f"s{i % 3}", i % 3, f"r{i:03}", float(i % 7), "pop" if i % 2 else "unknown", float(i)) for i in range(200)]
    tracks = spark.createDataFrame(rows, "k string, source_dataset string, source_priority int, rec_id string, energy double, genre string, popularity_score double")
    found = catalog.merge_groups(tracks, "k", ["energy"], base=("rec_id",))
    found.explain()
    plan = capfd.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan
    expected = sorted(map(str, found.collect()))
    assert len(expected) == 40
    monkeypatch.setattr(catalog, "SIZE_BUCKETS", 3)
    for few in (4, 5, 60, 199):  # groups of 5 rows in buckets of more
        assert sorted(map(str, catalog.merge_groups(tracks, "k", ["energy"], base=("rec_id",), few=few).collect())) == expected


def test_neighbours_sort_only_what_reaches_the_best(monkeypatch):
    rng, sorted_rows, lexsort = np.random.default_rng(4), [], np.lexsort
    y = np.repeat(rng.normal(size=(300, 6)), 2, axis=0)  # every vector twice, so that keys decide
    y /= np.linalg.norm(y, axis=1)[:, None]
    i = rng.permutation(len(y))
    monkeypatch.setattr(models.np, "lexsort", lambda keys: (sorted_rows.append(len(keys[0])), lexsort(keys))[1])
    found = models._best_of(i[:20], y[:20], i, y, 5)
    for n in range(20):
        want = sorted((-round(float(y[n] @ y[m]), 12), int(i[m])) for m in range(len(y)) if m != n)[:5]
        assert found[found["query"] == i[n]]["item"].tolist() == [m for _, m in want]
    assert len(sorted_rows) == 1 and sorted_rows[0] <= 20 * 7  # of 12,000 pairs
    assert len(models._best_of(i[:2], y[:2], i[:4], y[:4], 5)) == 6
