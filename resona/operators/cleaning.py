"""Cleaning jobs for tables of tracks, charts and trends: ordered steps, each from DataFrame to DataFrame.

A step whose columns are absent leaves the table as it is. Of rows that repeat a key the first in the given order stays;
gaps are filled from what is left after that. Tables without rows give no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.functions import numeric as N
from resona.functions import text as T
from resona.operators import catalog, tables

# Marks of missing text, ranges, mappings and bins of the jobs.
MISSING = ("nan", "NaN", "None", "")
UNIT_FEATURES = ("danceability", "energy", "speechiness", "acousticness", "instrumentalness", "liveness", "valence")
TRACK_RANGES = {
    "danceability": (0, 1), "energy": (0, 1), "loudness": (-60, 5), "speechiness": (0, 1), "acousticness": (0, 1), "instrumentalness": (0, 1), "liveness": (0, 1), "valence": (0, 1),
    "tempo": (30, 300), "duration_ms": (5000, 1800000), "popularity": (0, 100), "key": (0, 11), "mode": (0, 1), "time_signature": (1, 7),
}
YEARLY_RANGES = {
    "danceability": (0, 1), "energy": (0, 1), "loudness": (-60, 0), "mode": (0, 1), "key": (0, 11), "speechiness": (0, 1), "acousticness": (0, 1), "instrumentalness": (0, 1),
    "liveness": (0, 1), "valence": (0, 1), "tempo": (0, 300), "duration_ms": (1000, 600000), "time_signature": (3, 7),
}
CATEGORIES = ("mode", "key", "time_signature")
GENRE_GROUPS = {
    "pop": "pop", "k-pop": "pop", "dance pop": "pop", "electropop": "pop", "synth-pop": "pop",
    "rock": "rock", "indie rock": "rock", "alternative rock": "rock", "hard rock": "rock", "metal": "rock", "heavy metal": "rock", "death metal": "rock", "black metal": "rock",
    "edm": "electronic", "electronic": "electronic", "house": "electronic", "techno": "electronic", "trance": "electronic", "dubstep": "electronic", "ambient": "electronic", "drum and bass": "electronic",
    "hip hop": "hip-hop", "rap": "hip-hop", "trap": "hip-hop", "r&b": "r&b", "soul": "r&b", "funk": "r&b",
    "jazz": "jazz", "blues": "jazz", "swing": "jazz", "bebop": "jazz",
    "classical": "classical", "opera": "classical", "instrumental": "instrumental", "soundtrack": "instrumental", "film score": "instrumental",
    "country": "country", "folk": "folk", "bluegrass": "country", "americana": "folk",
    "reggae": "world", "latin": "world", "afrobeat": "world", "world": "world", "ethnic": "world",
}
PLATFORM_NAMES = {
    "insta": "instagram", "ig": "instagram", "snap": "snapchat", "snapchat stories": "snapchat", "instagram stories": "instagram", "instagram reels": "instagram", "reels": "instagram",
}
TREND_TYPES = {
    "filter": "visual_effect", "filters": "visual_effect", "dance challenge": "dance", "dance challenges": "dance", "sound trend": "audio", "audio trend": "audio", "music trend": "audio",
    "hashtag challenge": "challenge", "hashtag": "challenge", "meme": "meme_trend", "viral video": "video_trend",
}
TREND_GENRES = {"pop music": "pop", "hip hop": "hip_hop", "hip-hop": "hip_hop", "r&b": "rnb", "r and b": "rnb", "edm": "electronic", "electronic dance music": "electronic"}
#: every white space character of Unicode
SPACES = "".join(chr(c) for c in (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
ARTIST_SPLIT = r"[,&;]|\s+feat\.?\s+|\s+ft\.?\s+"


def _number(column: str) -> Column:
    """A double; what is no number, NaN included, is null."""
    return F.nanvl(F.col(column).try_cast("double"), F.lit(None).cast("double"))


def _stripped(column: str) -> Column:
    """Text without white space at its ends, trimmed by a list: a pattern costs more code and time."""
    return F.trim(F.col(column).cast("string"), F.lit(SPACES))


def _text(column: str) -> Column:
    """Stripped text; marks of missing text are null."""
    return N.null_tokens(_stripped(column), MISSING)


def _bare(column: str, instead: str = "") -> Column:
    """Lower-case stripped text whose punctuation is replaced."""
    return F.regexp_replace(F.lower(_stripped(column)), r"(?U)[^\w\s]", instead)


def _single_spaced(column: Column) -> Column:
    return F.regexp_replace(column, r"(?U)\s+", " ")


def _is(condition: Column) -> Column:
    """False where the condition is unknown."""
    return F.coalesce(condition, F.lit(False))


def _with(df: DataFrame, columns: Mapping[str, tuple[Sequence[str], Column]]) -> DataFrame:
    """Adds each (inputs, expression) whose input columns are there."""
    return df.withColumns({name: c for name, (needs, c) in columns.items() if all(n in df.columns for n in needs)})


def _clipped(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: N.clip(_number(c), lo, hi) for c, (lo, hi) in ranges.items() if c in df.columns})


def genre_group(genre: Column, groups: Mapping[str, str] = GENRE_GROUPS) -> Column:
    """The group of exactly this genre, else of the first listed genre it contains, else "other"."""
    exact = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])[genre]
    return F.when(genre == "unknown", "other").otherwise(F.coalesce(exact, T.first_contained(genre, dict(groups), "other")))


def track_table(df: DataFrame, order: Sequence[str], key: str = "track_id", ranges: Mapping[str, tuple[float, float]] = TRACK_RANGES) -> DataFrame:
    """Tracks with an id and a name, one per id; features inside their ranges, gaps at the median; genre groups and derived columns."""
    named = df.withColumn(key, _stripped(key)).where(F.col(key) != "")
    unique = tables.first_row(named, [key], order)
    unique = unique.withColumns({c: _text(c) for c in ("artists", "album_name", "track_name") if c in df.columns})
    if "track_name" in df.columns:
        unique = unique.where("track_name IS NOT NULL")
    unique = _with(unique, {"artist_count": (["artists"], F.coalesce(T.artist_count(F.col("artists")), F.lit(1)))})
    # the medians read the table several times
    inside = tables.settled(_clipped(unique, ranges))
    filled = catalog.fill_median(inside, [c for c in ranges if c in df.columns])
    if "explicit" in df.columns:
        filled = filled.withColumn("explicit", N.flexible_boolean(F.col("explicit")))
    if "track_genre" in df.columns:
        genre = F.lower(_stripped("track_genre"))
        filled = filled.withColumn("track_genre", F.when(genre.isNull() | genre.isin("nan", "none", ""), "unknown").otherwise(genre))
        group = F.col("genre_group")
        filled = filled.withColumn("genre_group", genre_group(F.col("track_genre"))).withColumns(
            {"is_mainstream": group.isin("pop", "rock", "hip-hop"), "is_electronic": group == "electronic", "is_instrumental": group.isin("classical", "instrumental")})
    c, minutes = F.col, F.col("duration_ms") / 60000
    return _with(filled, {
        "duration_minutes": (["duration_ms"], minutes),
        "is_short_track": (["duration_ms"], _is(minutes < 2.5)),
        "is_long_track": (["duration_ms"], _is(minutes > 6.0)),
        "energy_danceability": (["energy", "danceability"], c("energy") * c("danceability")),
        "is_high_energy_danceable": (["energy", "danceability"], _is((c("energy") > 0.7) & (c("danceability") > 0.7))),
        "mood_score": (["valence", "energy"], (c("valence") + c("energy")) / 2),
        "is_upbeat": (["valence", "energy"], _is((c("valence") > 0.6) & (c("energy") > 0.6))),
        "is_melancholy": (["valence", "energy"], _is((c("valence") < 0.4) & (c("energy") < 0.4))),
        "acoustic_instrumental": (["acousticness", "instrumentalness"], c("acousticness") * c("instrumentalness")),
        "is_acoustic": (["acousticness", "instrumentalness"], _is(c("acousticness") > 0.7)),
        "popularity_category": (["popularity"], N.cut_bins(c("popularity"), [0, 20, 50, 80, 100], ["low", "medium", "high", "viral"])),
        "is_popular": (["popularity"], _is(c("popularity") > 70)),
        "tempo_category": (["tempo"], N.cut_bins(c("tempo"), [0, 90, 120, 140, 300], ["slow", "moderate", "fast", "very_fast"])),
    })


def yearly_tracks(years: Mapping[str, DataFrame], order: Sequence[str], popularity: str = "track_pop", ranges: Mapping[str, tuple[float, float]] = YEARLY_RANGES) -> DataFrame:
    """The years' tables as one: a song, told by its bare track and artist names, stays in its first year; gaps take the column's
    median (categories: the most frequent value, the smallest of equals), then features are clipped to their ranges."""
    whole = tables.union_all(*[df.withColumn("source_year", F.lit(year)) for year, df in years.items()])
    keyed = whole.withColumns({"_track": _bare("track_name"), "_artist": _bare("artist_name")})
    unique = tables.first_row(keyed, ["_track", "_artist"], ["source_year", *order]).drop("_track", "_artist")
    numbers = [c for c in (popularity, *ranges) if c in whole.columns]
    typed = tables.settled(unique.withColumns({c: _number(c) for c in numbers}))
    filled = catalog.fill_median(typed, [c for c in numbers if c not in CATEGORIES])
    categories = [c for c in numbers if c in CATEGORIES]
    return _clipped(catalog.fill_mode(filled, categories) if categories else filled, ranges)


def _time(df: DataFrame, column: str) -> Column:
    return N.any_date(F.col(column)) if df.schema[column].dataType.simpleString() == "string" else F.col(column).cast("timestamp")


def platform_trends(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Trends, one per platform (as written) and bare description, with mapped platform, genre and type, and the parts and span of their time.

    Unknown genres are "unknown" and unknown types "other"; a platform that is null stays null.
    """
    if "platform" in df.columns and "trend_description" in df.columns:
        df = tables.first_row(df.withColumn("_said", _bare("trend_description")), ["platform", "_said"], order).drop("_said")
    else:
        df = df.dropDuplicates()

    def mapped(column: str, instead: str, values: dict[str, str], missing: str | None) -> Column:
        found = T.map_value(_single_spaced(_bare(column, instead)), values)
        return found if missing is None else F.when(found.isNull() | found.isin("nan", "null", "none", "", " "), missing).otherwise(found)

    named = _with(df, {"platform": (["platform"], mapped("platform", "", PLATFORM_NAMES, None)), "genre": (["genre"], mapped("genre", " ", TREND_GENRES, "unknown")),
                       "trend_type": (["trend_type"], mapped("trend_type", " ", TREND_TYPES, "other"))})
    timed = named.withColumns({c: _time(named, c) for c in ("start_date", "end_date") if c in df.columns})
    start, both = F.col("start_date"), ["start_date", "end_date"]
    timed = _with(timed, {"duration_days": (both, N.elapsed_days(start, F.col("end_date"))), "start_year": (both, F.year(start)), "start_month": (both, F.month(start)),
                          "start_quarter": (both, F.quarter(start)), "start_weekday": (both, F.date_format(start, "EEEE"))})
    edges = [float("-inf"), 7, 30, 90, 365, float("inf")]
    return _with(timed, {"duration_category": (["duration_days"], N.cut_bins(F.col("duration_days"), edges, ["short_term", "weekly", "monthly", "seasonal", "long_term"]))})


def chart_table(df: DataFrame, numbers: Sequence[str], percentages: Sequence[str], counts: Sequence[str], ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Messy numbers as doubles with gaps at the median, percentages within 0-100, counts from 0, and ratios that are 0 over nothing."""
    numbers = [c for c in numbers if c in df.columns]
    filled = catalog.fill_median(df.withColumns({c: N.messy_number(F.col(c).cast("string")) for c in numbers}), numbers)
    inside = filled.withColumns({c: N.clip(F.col(c), 0, 100) for c in percentages if c in df.columns}).withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in counts if c in df.columns})
    return _with(inside, {name: ([a, b], F.coalesce(N.safe_ratio(F.col(a), F.col(b)), F.lit(0.0))) for name, (a, b) in ratios.items()})


def music_catalog(df: DataFrame, order: Sequence[str], key: str = "track_id", name: str = "name", artist: str = "artist") -> DataFrame:
    """Catalog rows with id, name and artist, one per id: years, lengths, loudness and tempo outside their bounds are null, unit
    features are clipped; counts of artists, genres, tags and of the artist's tracks, categories, and the share of known features."""
    df = tables.first_of_few(tables.settled(df), [key], order)
    there = set(df.columns)
    df = df.withColumns({c: F.nullif(_stripped(c), F.lit("nan")) for c in (name, artist) if c in there})
    df = _with(df, {"name_length": ([name], F.char_length(name)), "artist_count": ([artist], F.coalesce(F.size(F.split(F.col(artist), ARTIST_SPLIT)), F.lit(1)))})
    if "year" in there:
        df = df.withColumn("year", N.within(_number("year"), 1900, 2025)).withColumn("decade", (F.floor(F.col("year") / 10) * 10).cast("int"))
    if "duration_ms" in there:
        df = df.withColumn("duration_ms", N.within(_number("duration_ms"), 10000, 1800000)).withColumn("duration_min", F.col("duration_ms") / 60000)
    df = _clipped(df, {c: (0, 1) for c in UNIT_FEATURES})
    df = _with(df, {"loudness": (["loudness"], N.within(_number("loudness"), -60, 5))})
    if "tempo" in there:
        df = df.withColumn("tempo", N.within(_number("tempo"), 50, 250))
        df = df.withColumn("tempo_category", N.cut_bins(F.col("tempo"), [0, 90, 120, 140, 200, 300], ["Slow", "Moderate", "Fast", "Very Fast", "Extreme"], include_lowest=True))
    listed = {c: F.nullif(F.lower(_stripped(c)), F.lit("nan")) for c in ("genre", "tags") if c in there}
    df = df.withColumns({c: _single_spaced(F.regexp_replace(e, r"(?U)[^\w\s,]", "")) if c == "genre" else e for c, e in listed.items()})
    df = _with(df, {"genre_count": (["genre"], T.list_count(F.col("genre"))), "tag_count": (["tags"], T.list_count(F.col("tags")))})
    df = df.withColumns({c: _number(c).cast("int") for c in CATEGORIES if c in there})
    energy, valence = F.col("energy"), F.col("valence")
    mood = (F.when(energy.isNull() | valence.isNull(), "Unknown").when(energy >= 0.5, F.when(valence >= 0.5, "Happy/Energetic").otherwise("Angry/Intense"))
            .otherwise(F.when(valence >= 0.5, "Peaceful/Calm").otherwise("Sad/Melancholic")))
    features = [c for c in (*UNIT_FEATURES, "loudness", "tempo") if c in there]
    df = _with(df, {
        "mood_category": (["energy", "valence"], mood),
        "danceability_level": (["danceability"], N.cut_bins(F.col("danceability"), [0, 0.3, 0.6, 0.8, 1.0], ["Low", "Medium", "High", "Very High"], include_lowest=True)),
        "acoustic_electronic": (["acousticness", "energy"], F.when(F.col("acousticness") > 0.6, "Acoustic").when(energy > 0.7, "Electronic").otherwise("Mixed")),
        **({"feature_completeness": ([], F.size(F.array_compact(F.array(*features))) / len(features))} if features else {}),
    })
    if artist not in there:
        return tables.drop_incomplete(df, [key, name])
    # an artist may hold a third of the rows: counted before the shuffle, joined back as one row per artist.
    # Rows that the last step drops count too.
    per_artist = tables.settled(df.where(F.col(artist).isNotNull()).groupBy(artist).agg(F.count("*").alias("artist_track_count")))
    return tables.join_by_hash(tables.drop_incomplete(df, [key, name, artist]), per_artist, artist)


def audio_table(df: DataFrame, names: Mapping[str, str], ranges: Mapping[str, tuple[float, float]], plain: Sequence[str] = ("key", "mode", "time_signature", "duration_ms", "loudness")) -> DataFrame:
    """Standard column names; numeric features clipped to their ranges and, but for ``plain`` ones, scaled to 0-1; rows with a gap go."""
    df = tables.rename(df, names)
    numeric = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float", "int", "bigint")}
    scaled = {}
    for c, (low, high) in ranges.items():
        if c in numeric:
            inside = N.clip(_number(c), low, high)
            scaled[c] = inside if c in plain or low == high else (inside - low) / (high - low)
    return df.withColumns(scaled).na.drop("any", subset=[c for c in ranges if c in df.columns])
