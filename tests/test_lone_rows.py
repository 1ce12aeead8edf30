"""Rows whose key no other row has aren't shuffled."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from resona.operators import catalog, cleaning, tables
from resona.plans import scoring
from resona.sources.fixtures import view


def _songs(spark):
    rows = [(n, f"t{n if n % 9 else n % 2}", f"Song {n}", f" A{n % 5}" if n % 4 else None, "1999", 0.1 * (n % 9)) for n in range(80)]
    rows += [(90, None, "M", "A1", "2000", 0.5), (91, None, "N", "A1", "2000", 0.5), (92, "u", None, "A1", "2000", 0.5)]
    return spark.createDataFrame(rows, "n int, track_id string, name string, artist string, year string, energy double")


def _catalog_of_before(df):
    """music_catalog's rows and counts, by windows."""
    first = tables.first_per_key(df, ["track_id"], ["n"]).withColumn("artist", F.trim("artist"))
    counts = first.where("artist IS NOT NULL").groupBy("artist").count().collect()
    held = {r[0]: r[1] for r in counts}
    return sorted((r.n, r.artist, held[r.artist]) for r in first.collect() if r.track_id and r.name and r.artist)


def test_catalog_rows_are_shuffled_only_where_ids_repeat(spark, capfd):
    df = _songs(spark)
    found = cleaning.music_catalog(df, ["n"])
    found.explain()
    plan = capfd.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("LeftAnti") == 1 and plan.count("LeftSemi") == 1
    assert sorted((r.n, r.artist, r.artist_track_count) for r in found.collect()) == _catalog_of_before(df)


@pytest.mark.parametrize("hashes", [1, 3])
def test_equal_hashes_and_many_repeats_change_nothing(spark, monkeypatch, hashes):
    df, real = _songs(spark), F.xxhash64
    expected, first = _catalog_of_before(df), sorted(map(str, tables.first_row(df, ["track_id"], ["n"]).collect()))
    lone, shared = tables.lone_and_shared(df, ["track_id"])
    assert lone.count() + shared.count() == df.count() and lone.select("track_id").distinct().count() == lone.count() > 60
    assert tables.lone_and_shared(df, ["track_id"], most=1)[0] is None
    assert sorted(map(str, tables.first_of_few(df, ["track_id"], ["n"], most=1).collect())) == first
    monkeypatch.setattr(F, "xxhash64", lambda *columns: F.pmod(real(*columns), F.lit(hashes)))
    assert sorted(map(str, tables.first_of_few(df, ["track_id"], ["n"]).collect())) == first
    assert sorted((r.n, r.artist, r.artist_track_count) for r in cleaning.music_catalog(df, ["n"]).collect()) == expected


def test_lone_rows_are_masters_as_they_are(spark, monkeypatch):
    odd = [("a", None, 1, "r1", "x", float("nan"), None, None), ("b", "s", 2, "r2", None, None, "unknown", 7), ("c", "youtube", 3, "r3", "y", 0.5, "pop", 0), (None, "s", 1, "r4", "n", 0.5, "pop", 3)]
    more = [(f"g{i % 3}", f"s{i % 2}", i % 2, f"q{i}", "z", float(i), "rock" if i % 2 else "unknown", i) for i in range(9)]
    df = spark.createDataFrame(odd + more, "k string, source_dataset string, source_priority int, rec_id string, track_name string, energy double, genre string, popularity_score int")
    want, found = catalog.merge_groups(df, "k", ["energy"], base=("track_name",)), catalog.merge_few_groups(df, "k", ["energy"], base=("track_name",))
    assert [(f.name, f.dataType.simpleString()) for f in want.schema.fields] == [(f.name, f.dataType.simpleString()) for f in found.schema.fields]
    expected = sorted(map(str, want.collect()))
    assert len(expected) == 6 and sorted(map(str, found.collect())) == expected
    real = F.xxhash64
    for hashes in (1, 4):
        monkeypatch.setattr(F, "xxhash64", lambda *columns, n=hashes: F.pmod(real(*columns), F.lit(n)))
        assert sorted(map(str, catalog.merge_few_groups(df, "k", ["energy"], base=("track_name",)).collect())) == expected


def test_integration_shuffles_no_rows_of_their_own(spark, sf_dir, capfd):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scoring.flagship(view(spark, sf_dir, "tracks").limit(300)).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = capfd.readouterr().out
    assert "BroadcastHashJoin [genre" in plan and "hashpartitioning(genre" not in plan and "hashpartitioning(k" not in plan
