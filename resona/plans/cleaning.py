"""Queries over the cleaning jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from resona.functions import numeric as N
from resona.operators import cleaning, stats
from resona.plans.query import query

_ONE_PER_ID = """t AS (SELECT * EXCLUDE (track_id), trim(track_id) AS track_id FROM raw_tracks WHERE trim(track_id) <> ''),
u AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY row_id, popularity) AS n FROM t) WHERE n = 1)"""


def _clip(column: str, low: float, high: float) -> str:
    return f"CASE WHEN {column} IS NOT NULL THEN least(greatest(CAST({column} AS DOUBLE), {float(low)}), {float(high)}) END"


def _bins(column: str, edges: list, labels: list) -> str:
    return "CASE " + " ".join(f"WHEN {column} <= {e} THEN '{label}'" for e, label in zip(edges, labels, strict=True)) + " END"


def _values(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in values.items()) + f" ELSE {column} END"


def _marks(column: str) -> str:
    return f"CASE WHEN trim({column}) NOT IN ('nan', 'NaN', 'None', '') THEN trim({column}) END"


_TRACKS = {**{c: c for c in cleaning.TRACK_RANGES}, "popularity": "TRY_CAST(popularity AS DOUBLE)", "duration_ms": "TRY_CAST(duration_ms AS DOUBLE)"}


@query("raw_tracks", f"""
WITH {_ONE_PER_ID},
x AS (SELECT row_id, track_id, {_marks('artists')} AS artists, {_marks('track_name')} AS track_name, coalesce(lower(trim(explicit)) IN ('true', '1', 'yes'), false) AS explicit,
  CASE WHEN track_genre IS NULL OR lower(trim(track_genre)) IN ('nan', 'none', '') THEN 'unknown' ELSE lower(trim(track_genre)) END AS track_genre,
  {', '.join(f"{_clip(_TRACKS[c], *r)} AS {c}" for c, r in cleaning.TRACK_RANGES.items())} FROM u WHERE {_marks('track_name')} IS NOT NULL),
m AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in cleaning.TRACK_RANGES)} FROM x),
f AS (SELECT row_id, track_id, artists, track_name, explicit, track_genre, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in cleaning.TRACK_RANGES)} FROM x, m),
g AS (SELECT *, CASE WHEN track_genre = 'unknown' THEN 'other' {' '.join(f"WHEN track_genre = '{a}' THEN '{b}'" for a, b in cleaning.GENRE_GROUPS.items())}
  {' '.join(f"WHEN contains(track_genre, '{a}') THEN '{b}'" for a, b in cleaning.GENRE_GROUPS.items())} ELSE 'other' END AS genre_group FROM f)
SELECT row_id, track_id, artists, CAST(coalesce(len(regexp_extract_all(artists, '[,;&]')) + 1, 1) AS INT) AS artist_count, track_name, explicit, track_genre, genre_group, genre_group IN ('pop', 'rock', 'hip-hop') AS is_mainstream,
  {', '.join(cleaning.TRACK_RANGES)}, round(duration_ms / 60000, 6) AS duration_minutes, duration_ms / 60000 < 2.5 AS is_short_track, duration_ms / 60000 > 6 AS is_long_track,
  round(energy * danceability, 9) AS energy_danceability, energy > 0.7 AND danceability > 0.7 AS is_high_energy_danceable, round((valence + energy) / 2, 9) AS mood_score, valence < 0.4 AND energy < 0.4 AS is_melancholy,
  round(acousticness * instrumentalness, 9) AS acoustic_instrumental, CASE WHEN popularity > 0 THEN {_bins('popularity', [20, 50, 80, 100], ['low', 'medium', 'high', 'viral'])} END AS popularity_category,
  {_bins('tempo', [90, 120, 140, 300], ['slow', 'moderate', 'fast', 'very_fast'])} AS tempo_category FROM g""")
def ds14_track_cleaning_job(raw_tracks):
    out = cleaning.track_table(raw_tracks.drop("album_name", "tags", "year", "source_year"), ["row_id", "popularity"])
    rounded = {"duration_minutes": 6, "energy_danceability": 9, "mood_score": 9, "acoustic_instrumental": 9}
    return out.select(
        "row_id", "track_id", "artists", "artist_count", "track_name", "explicit", "track_genre", "genre_group", "is_mainstream", *cleaning.TRACK_RANGES, *[F.round(c, d).alias(c) for c, d in rounded.items()],
        "is_short_track", "is_long_track", "is_high_energy_danceable", "is_melancholy", "popularity_category", "tempo_category")


_YEARLY = {"track_pop": "TRY_CAST(popularity AS DOUBLE)", **{c: f"TRY_CAST({c} AS DOUBLE)" for c in cleaning.YEARLY_RANGES}}
_FILL = {c: f"(SELECT {c} FROM y WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" if c in cleaning.CATEGORIES else f"(SELECT median({c}) FROM y)" for c in _YEARLY}
_CLEAN_YEARS = f"""
WITH k AS (SELECT *, regexp_replace(lower(trim(track_name)), '[^\\w\\s]', '', 'g') AS kt, regexp_replace(lower(trim(artists)), '[^\\w\\s]', '', 'g') AS ka FROM raw_tracks WHERE source_year IS NOT NULL),
y AS (SELECT row_id, track_name, artists, source_year, {', '.join(f'{e} AS {c}' for c, e in _YEARLY.items())} FROM (SELECT *, row_number() OVER (PARTITION BY kt, ka ORDER BY source_year, row_id, popularity) AS n FROM k) WHERE n = 1),
m AS (SELECT {', '.join(f'{e} AS m_{c}' for c, e in _FILL.items())}),
c AS (SELECT row_id, track_name, artists, source_year, coalesce(track_pop, m_track_pop) AS track_pop, {', '.join(f"{_clip(f'coalesce({c}, m_{c})', *r)} AS {c}" for c, r in cleaning.YEARLY_RANGES.items())} FROM y, m)
"""


def _years(raw_tracks):
    named = raw_tracks.withColumnsRenamed({"popularity": "track_pop", "artists": "artist_name"})
    year = lambda y: named.where(F.col("album_name") == f"tiktok_{y}").select("row_id", "track_name", "artist_name", "track_pop", *cleaning.YEARLY_RANGES)
    return cleaning.yearly_tracks({y: year(y) for y in ("2021", "2022")}, ["row_id", "track_pop"])


@query("raw_tracks", _CLEAN_YEARS + f"SELECT row_id, track_name, artists, source_year, track_pop, {', '.join(cleaning.YEARLY_RANGES)} FROM c")
def ds14_yearly_cleaning_job(raw_tracks):
    return _years(raw_tracks).select("row_id", "track_name", F.col("artist_name").alias("artists"), "source_year", "track_pop", *cleaning.YEARLY_RANGES)


@query("raw_tracks", _CLEAN_YEARS + """, l AS (UNPIVOT (SELECT source_year, track_pop, energy, tempo, loudness FROM c) ON track_pop, energy, tempo, loudness INTO NAME feature VALUE v),
a AS (SELECT feature, avg(v) FILTER (WHERE source_year = '2021') AS b, avg(v) FILTER (WHERE source_year = '2022') AS e FROM l GROUP BY 1)
SELECT feature, round(e - b, 6) AS change, round((e - b) / nullif(b, 0) * 100, 6) AS percent, CASE WHEN e > b THEN 'increase' WHEN e < b THEN 'decrease' ELSE 'stable' END AS direction FROM a""")
def ds14_yearly_trends(raw_tracks):
    trends = stats.year_over_year(_years(raw_tracks), "source_year", ["track_pop", "energy", "tempo", "loudness"])
    return trends.select("feature", F.round("change", 6).alias("change"), F.round("percent", 6).alias("percent"), "direction")


def _tidy(column: str, instead: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({column})), '[^\\w\\s]', '{instead}', 'g'), '\\s+', ' ', 'g')"


@query("social_trends", f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY platform, regexp_replace(lower(trim(trend_description)), '[^\\w\\s]', '', 'g') ORDER BY event_id) AS n FROM social_trends),
c AS (SELECT event_id, {_tidy('platform', '')} AS platform, {_tidy('genre', ' ')} AS genre, {_tidy('trend_type', ' ')} AS trend_type, start_date, CAST(floor((epoch(end_date) - epoch(start_date)) / 86400) AS BIGINT) AS duration_days FROM k WHERE n = 1),
d AS (SELECT event_id, {_values('platform', cleaning.PLATFORM_NAMES)} AS platform, {_values('genre', cleaning.TREND_GENRES)} AS genre, {_values('trend_type', cleaning.TREND_TYPES)} AS trend_type, start_date, duration_days FROM c)
SELECT event_id, platform, CASE WHEN genre IN ('nan', 'null', 'none', '', ' ') THEN 'unknown' ELSE genre END AS genre, CASE WHEN trend_type IN ('nan', 'null', 'none', '', ' ') THEN 'other' ELSE trend_type END AS trend_type,
  duration_days, CAST(year(start_date) AS INT) AS start_year, CAST(month(start_date) AS INT) AS start_month, CAST(quarter(start_date) AS INT) AS start_quarter, dayname(start_date) AS start_weekday,
  CASE WHEN duration_days <= 7 THEN 'short_term' WHEN duration_days <= 30 THEN 'weekly' WHEN duration_days <= 90 THEN 'monthly' WHEN duration_days <= 365 THEN 'seasonal' ELSE 'long_term' END AS duration_category FROM d""")
def ds14_trend_cleaning_job(social_trends):
    out = cleaning.platform_trends(social_trends, ["event_id"])
    return out.select("event_id", "platform", "genre", "trend_type", "duration_days", "start_year", "start_month", "start_quarter", "start_weekday", "duration_category")


_CHART = ["spotify_streams", "spotify_playlist_reach", "youtube_views", "youtube_likes", "spotify_popularity"]
_RATIOS = {"spotify_streams_per_reach": ("spotify_streams", "spotify_playlist_reach"), "youtube_like_ratio": ("youtube_likes", "youtube_views"), "spotify_youtube_ratio": ("spotify_streams", "youtube_views")}


@query("chart_metrics", f"""
WITH n AS (SELECT chart_id, {', '.join(f"TRY_CAST(replace(replace({c}, ',', ''), ' ', '') AS DOUBLE) AS {c}" for c in _CHART)} FROM chart_metrics),
m AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in _CHART)} FROM n),
f AS (SELECT chart_id, {', '.join(f'greatest(coalesce({c}, m_{c}), 0) AS {c}' for c in _CHART[:4])}, least(greatest(coalesce(spotify_popularity, m_spotify_popularity), 0), 100) AS spotify_popularity FROM n, m)
SELECT *, {', '.join(f'round(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END, 6) AS {r}' for r, (a, b) in _RATIOS.items())} FROM f""")
def ds14_chart_cleaning_job(chart_metrics):
    out = cleaning.chart_table(chart_metrics.drop("source_year"), _CHART, ["spotify_popularity"], ["spotify_streams", "youtube_views"], _RATIOS)
    return out.withColumns({r: F.round(r, 6) for r in _RATIOS})


_UNIT = list(cleaning.UNIT_FEATURES)


@query("raw_tracks", f"""
WITH u AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY row_id) AS n FROM raw_tracks) WHERE n = 1),
x AS (SELECT row_id, track_id, nullif(trim(track_name), 'nan') AS name, nullif(trim(artists), 'nan') AS artist, CASE WHEN CAST(year AS DOUBLE) BETWEEN 1900 AND 2025 THEN CAST(year AS DOUBLE) END AS year,
  CASE WHEN CAST(duration_ms AS DOUBLE) BETWEEN 10000 AND 1800000 THEN CAST(duration_ms AS DOUBLE) END AS duration_ms, {', '.join(f'{_clip(c, 0, 1)} AS {c}' for c in _UNIT)},
  CASE WHEN loudness BETWEEN -60 AND 5 THEN loudness END AS loudness, CASE WHEN tempo BETWEEN 50 AND 250 THEN tempo END AS tempo, lower(trim(tags)) AS tags, nullif(lower(trim(track_genre)), 'nan') AS genre, key, mode FROM u),
a AS (SELECT artist, count(*) AS artist_track_count FROM x GROUP BY 1)
SELECT row_id, track_id, name, artist, CAST(length(name) AS INT) AS name_length, CAST(len(regexp_split_to_array(artist, '[,&;]|\\s+feat\\.?\\s+|\\s+ft\\.?\\s+')) AS INT) AS artist_count, artist_track_count, year, CAST(floor(year / 10) * 10 AS INT) AS decade,
  round(duration_ms / 60000, 6) AS duration_min, loudness, tempo, {_bins('tempo', [90, 120, 140, 200, 300], ['Slow', 'Moderate', 'Fast', 'Very Fast', 'Extreme'])} AS tempo_category, genre, CAST(CASE WHEN genre IS NULL THEN 0 ELSE len(string_split(genre, ',')) END AS INT) AS genre_count,
  CAST(CASE WHEN tags IS NULL THEN 0 ELSE len(string_split(tags, ',')) END AS INT) AS tag_count, key, mode,
  CASE WHEN energy IS NULL OR valence IS NULL THEN 'Unknown' WHEN energy >= 0.5 THEN CASE WHEN valence >= 0.5 THEN 'Happy/Energetic' ELSE 'Angry/Intense' END WHEN valence >= 0.5 THEN 'Peaceful/Calm' ELSE 'Sad/Melancholic' END AS mood_category,
  {_bins('danceability', [0.3, 0.6, 0.8, 1.0], ['Low', 'Medium', 'High', 'Very High'])} AS danceability_level, CASE WHEN acousticness > 0.6 THEN 'Acoustic' WHEN energy > 0.7 THEN 'Electronic' ELSE 'Mixed' END AS acoustic_electronic,
  round(({' + '.join(f'CAST({c} IS NOT NULL AS INT)' for c in [*_UNIT, 'loudness', 'tempo'])}) / 9.0, 6) AS feature_completeness
FROM x JOIN a USING (artist) WHERE track_id IS NOT NULL AND name IS NOT NULL""")
def ds14_catalog_cleaning_job(raw_tracks):
    named = raw_tracks.drop("album_name", "popularity", "explicit", "time_signature", "source_year").withColumnsRenamed({"track_name": "name", "artists": "artist", "track_genre": "genre"})
    out = cleaning.music_catalog(named, ["row_id"])
    return out.select(
        "row_id", "track_id", "name", "artist", "name_length", "artist_count", "artist_track_count", "year", "decade", F.round("duration_min", 6).alias("duration_min"), "loudness", "tempo", "tempo_category", "genre", "genre_count",
        "tag_count", "key", "mode", "mood_category", "danceability_level", "acoustic_electronic", F.round("feature_completeness", 6).alias("feature_completeness"))


_AUDIO = {"danceability": (0, 1), "energy": (0, 1), "tempo": (50, 250), "loudness": (-60, 0), "mode": (0, 1), "duration_ms": (10000, 1800000)}


@query("raw_tracks", f"""
WITH c AS (SELECT row_id, {', '.join(f"{_clip('TRY_CAST(' + c + ' AS DOUBLE)', *r)} AS {c}" for c, r in _AUDIO.items())} FROM raw_tracks)
SELECT row_id, round(danceability, 9) AS danceability, energy, round((tempo - 50) / 200, 9) AS tempo, loudness, mode, duration_ms FROM c WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _AUDIO)}""")
def ds14_audio_cleaning_job(raw_tracks):
    source = raw_tracks.select(F.col("row_id").alias("ROW_ID"), F.col("danceability").alias("Danceability"), "energy", F.col("tempo").alias("bpm"), "loudness", "mode", N.to_number(F.col("duration_ms")).alias("Length"))
    out = cleaning.audio_table(source, {"bpm": "tempo", "Length": "duration_ms"}, _AUDIO)
    return out.select("row_id", F.round("danceability", 9).alias("danceability"), "energy", F.round("tempo", 9).alias("tempo"), "loudness", "mode", "duration_ms")
