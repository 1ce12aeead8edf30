"""The cleaning jobs on odd rows: nulls, ties, letters beyond ASCII, absent columns, empty tables."""

from __future__ import annotations

from resona.operators import cleaning, tables


def _rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_first_row_keeps_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), (None, 5, "n"), (None, 4, "m")], "key string, n int, _first string")
    assert sorted(_rows(tables.first_row(df, ["key"], ["n"]), "key", "n", "_first"), key=repr) == [("a", 1, None), (None, 4, "m")]


def test_track_table(spark):
    df = spark.createDataFrame(
        [(1, " a ", "X, Y & Z", "Song", "120", "TRUE", "Symphonic Black Metal", 0.9), (2, "a", "X", "Other", "5", "no", "pop", 0.1), (3, "b", None, "nan", "5", None, None, 0.1),
         (4, "c", "", " Été ", "n/a", None, None, float("nan")), (5, "\t", "X", "T", "1", None, None, 0.5), (6, None, "X", "T", "1", None, None, 0.5)],
        "n int, track_id string, artists string, track_name string, popularity string, explicit string, track_genre string, energy double")
    out = cleaning.track_table(df, ["n"])
    assert sorted(_rows(out, "n", "track_id", "artist_count", "track_name", "popularity", "explicit", "genre_group", "energy", "popularity_category")) == [
        (1, "a", 3, "Song", 100.0, True, "rock", 0.9, "viral"), (4, "c", 1, "Été", 100.0, False, "other", 0.9, "viral")]
    assert cleaning.track_table(df.where("false"), ["n"]).count() == 0
    assert "duration_minutes" not in out.columns


def test_yearly_tracks_tell_letters_beyond_ascii_apart(spark):
    schema = "n int, track_name string, artist_name string, track_pop string, tempo double, key double"
    first = spark.createDataFrame([(1, "Ça va!", "É", "10", 400.0, 3.0), (2, "a va", "É", "x", None, 3.0)], schema)
    second = spark.createDataFrame([(1, " ça VA", "é", "90", 1.0, 1.0), (3, None, None, "30", 100.0, None)], schema)
    out = cleaning.yearly_tracks({"2021": first, "2022": second}, ["n"])
    assert sorted(_rows(out, "n", "source_year", "track_pop", "tempo", "key")) == [(1, "2021", 10.0, 300.0, 3.0), (2, "2021", 20.0, 250.0, 3.0), (3, "2022", 30.0, 100.0, 3.0)]


def test_platform_trends(spark):
    df = spark.createDataFrame(
        [(1, "IG", "Hey you!", "r&b", "Hashtag", "2024-01-01", "2024-01-08"), (2, "IG", "hey you", "pop", "meme", "2024-01-01", None), (3, None, "hey you", None, None, "bad", "2024-01-01")],
        "n int, platform string, trend_description string, genre string, trend_type string, start_date string, end_date string")
    out = cleaning.platform_trends(df, ["n"])
    assert sorted(_rows(out, "n", "platform", "genre", "trend_type", "duration_days", "start_quarter", "duration_category")) == [
        (1, "instagram", "r b", "challenge", 7, 1, "short_term"), (3, None, "unknown", "other", None, None, None)]
    assert "duration_days" not in cleaning.platform_trends(df.drop("end_date"), ["n"]).columns


def test_chart_table(spark):
    df = spark.createDataFrame([("1,000", "N/A", "150"), ("3 000", "0", "-5"), ("-7", "2", None)], "streams string, reach string, popularity string")
    out = cleaning.chart_table(df, ["streams", "reach", "popularity", "absent"], ["popularity"], ["streams"], {"per_reach": ("streams", "reach"), "none": ("streams", "absent")})
    assert sorted(_rows(out, "streams", "reach", "popularity", "per_reach")) == [(0.0, 2.0, 72.5, 0.0), (1000.0, 1.0, 100.0, 1000.0), (3000.0, 0.0, 0.0, 0.0)]
    assert "none" not in out.columns


def test_music_catalog(spark):
    df = spark.createDataFrame(
        [(1, "a", " N ", "A feat. B", "1899", 49.0, 0.5, 0.5, "Rock, R&B!", None), (2, "b", "M", "A feat. B", "1999", 50.0, None, 0.2, None, "x,y,z"), (3, "c", None, "A feat. B", "2000", 90.0, 1.5, 0.2, "nan", "x"), (4, None, "M", "A", "2000", 90.0, 0.1, 0.1, "pop", "x")],
        "n int, track_id string, name string, artist string, year string, tempo double, energy double, valence double, genre string, tags string")
    out = cleaning.music_catalog(df, ["n"])
    assert sorted(_rows(out, "n", "name", "artist_count", "artist_track_count", "decade", "tempo_category", "genre", "genre_count", "tag_count", "mood_category", "feature_completeness"), key=repr) == [
        (1, "N", 2, 3, None, None, "rock, rb", 2, 0, "Happy/Energetic", 2 / 3), (2, "M", 2, 3, 1990, "Slow", None, 0, 3, "Unknown", 2 / 3)]


def test_audio_table(spark):
    df = spark.createDataFrame([(1, 300.0, 5.0, "x"), (2, 150.0, -70.0, "y"), (3, float("nan"), -3.0, "z")], "ID int, bpm double, Loudness double, mood string")
    out = cleaning.audio_table(df, {"bpm": "tempo"}, {"tempo": (50, 250), "loudness": (-60, 0), "mood": (0, 1), "absent": (0, 1)})
    assert sorted(_rows(out, "id", "tempo", "loudness", "mood")) == [(1, 1.0, 0.0, "x"), (2, 0.5, -60.0, "y")]
