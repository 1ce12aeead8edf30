"""Merging by cleaned names reads the names once."""

from __future__ import annotations

from pyspark.sql import functions as F

from resona.operators import matching


def test_keys_are_cleaned_once(spark):
    cleaned = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def clean(name):
        cleaned.add(1)
        return name and name.lower()

    rows = [(f"r{i}", "s", "Ab" * 12 if i < 3 else None, 0.1 * i, 50.0, 1, "pop", True, False, False) for i in range(5)]
    songs = spark.createDataFrame(rows, "rec_id string, source_dataset string, name string, energy double, normalized_popularity double, source_count int, genre string, spotify boolean, tiktok boolean, youtube boolean")
    songs = songs.withColumns({c: F.col("energy") for c in ("danceability", "valence", "acousticness", "instrumentalness")})
    merged = matching.merge_similar(songs.withColumn("song", clean("name")), "song", ["energy", "danceability", "valence", "acousticness", "instrumentalness"]).collect()
    assert sorted((r.song or "", r.merged) for r in merged) == [("", 2), ("ab" * 12, 3)]
    assert cleaned.value == len(rows)
