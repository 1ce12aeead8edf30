"""Queries over column functions, column standards and row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from resona.functions import numeric as N
from resona.functions import text as T
from resona.operators import tables
from resona.plans.query import query


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _chain(column: str, steps) -> str:
    """SQL for the replacements of a key, trimmed."""
    return "trim(" + reduce(lambda s, p: f"regexp_replace({s}, '{_quoted(p[0])}', '{p[1]}', 'g')", steps, f"lower({column})") + ")"


_KEY = lambda c: _chain(c, [*T.MATCH_STEPS, T.AMPERSAND_STEP, *T.MATCH_LAST_STEPS])


@query("tracks", f"SELECT rec_id, {_KEY('track_name')} AS track_key, {_KEY('artist_name')} || '||' || {_KEY('track_name')} AS composite FROM tracks")
def str1_str4_match_keys(tracks):
    return tracks.select("rec_id", T.match_key(F.col("track_name")).alias("track_key"), T.composite_key(F.col("artist_name"), F.col("track_name")).alias("composite"))


@query("tracks", f"SELECT rec_id, {_chain('track_name', [*T.MATCH_STEPS, *T.MATCH_LAST_STEPS])} AS k2, {_chain('track_name', T.DEDUP_STEPS)} AS k3 FROM tracks")
def str2_str3_short_keys(tracks):
    return tracks.select("rec_id", T.match_key(F.col("track_name"), ampersand=False).alias("k2"), T.dedup_key(F.col("track_name")).alias("k3"))


@query("tracks", f"SELECT rec_id, {_chain('artist_name', T.ARTIST_STEPS)} AS artist_clean, {_chain('track_name', T.TRACK_STEPS)} AS track_clean FROM tracks")
def str5_str6_clean_names(tracks):
    return tracks.select("rec_id", T.clean_artist(F.col("artist_name")).alias("artist_clean"), T.clean_track(F.col("track_name")).alias("track_clean"))


@query("tracks", """
SELECT rec_id, 1 + len(regexp_extract_all(track_name || ', B & C', '[,;&]')) AS artists, len(string_split(track_name || ',x', ',')) AS items,
  string_split(regexp_replace(lower(track_name), '\\s+', ' ', 'g'), ' ') AS words,
  CASE WHEN trim(artist_name) <> '' THEN trim(artist_name) || ' - ' || trim(track_name) ELSE trim(track_name) END AS search_key,
  track_name || ' by ' || artist_name || ' (' || genre || ')' AS headline FROM tracks""")
def str8_str9_str16_str17_str18_lists(tracks):
    named = tracks.select("rec_id", "track_name", "artist_name", "genre")
    return named.select(
        "rec_id", T.artist_count(F.concat("track_name", F.lit(", B & C"))).alias("artists"), T.list_count(F.concat("track_name", F.lit(",x"))).alias("items"),
        T.tokens(F.col("track_name")).alias("words"), T.search_key(F.col("artist_name"), F.col("track_name")).alias("search_key"),
        F.format_string("%s by %s (%s)", "track_name", "artist_name", "genre").alias("headline"))


@query("tracks", f"""
SELECT rec_id, regexp_extract(track_name, '{T.FEATURED}', 2) <> '' AS has_featured,
  len(list_filter(regexp_split_to_array(regexp_extract(track_name, '{T.FEATURED}', 2), '{T.FEATURED_SPLIT}'), lambda p: trim(p) <> '')) AS n_featured
FROM tracks""")
def str7_featured_artists(tracks):
    parts = T.featured_artists(F.col("track_name"))
    return tracks.select("rec_id", parts.alias("p")).select("rec_id", (F.size("p.featured") > 0).alias("has_featured"), F.size("p.featured").alias("n_featured"))


@query("social_trends", r"""
SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(platform), '[_-]', ' ', 'g'), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) AS platform_text,
  CASE platform WHEN 'IG' THEN 'instagram' WHEN 'snap!' THEN 'snapchat' WHEN 'Instagram  Reels' THEN 'instagram reels' ELSE platform END AS platform_name,
  CASE WHEN contains(lower(genre), 'hip') THEN 'urban' WHEN contains(lower(genre), 'pop') THEN 'pop' WHEN contains(lower(genre), 'edm') THEN 'electronic' ELSE 'other' END AS genre_group,
  coalesce(nullif(regexp_extract(trend_description, '#(\d+)', 1), ''), 'unknown') AS trend_no,
  trim(regexp_replace(trend_description, '\s+', ' ', 'g')) AS shown FROM social_trends""")
def str10_str14_category_text(social_trends):
    return social_trends.select(
        "event_id", T.category_text(F.col("platform")).alias("platform_text"),
        T.map_value(F.col("platform"), {"IG": "instagram", "snap!": "snapchat", "Instagram  Reels": "instagram reels"}).alias("platform_name"),
        T.first_contained(F.col("genre"), {"hip": "urban", "pop": "pop", "edm": "electronic"}, "other").alias("genre_group"),
        T.extract_or(F.col("trend_description"), r"#(\d+)", "unknown").alias("trend_no"), T.display_text(F.col("trend_description")).alias("shown"))


@query("tracks", rf"""
WITH cleaned AS (SELECT rec_id, artist_name AS a, track_name AS t,
  trim(regexp_replace(artist_name, '{T.COMMON}', '', 'g')) AS a2, trim(regexp_replace(track_name, '{T.COMMON}', '', 'g')) AS t2 FROM tracks)
SELECT rec_id, a AS artist, t AS track FROM cleaned
UNION ALL SELECT rec_id, a2, t2 FROM cleaned WHERE a2 <> a OR t2 <> t
UNION ALL SELECT rec_id, array_to_string(list_transform(regexp_split_to_array(trim(a), '\s+'), lambda w: w[1:1]), ' '), t FROM cleaned
  WHERE length(a) > 20 AND len(regexp_split_to_array(trim(a), '\s+')) > 1""")
def str15_udf5_matching_variants(tracks):
    return tracks.select("rec_id", F.inline(T.matching_variants(F.col("artist_name"), F.col("track_name"))))


@query("events", """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, '{"id":' || event_id || ',"k":' || CAST(json_extract(props, '$.k') AS INT) || '}' AS merged FROM events""")
def str19_json_merge(events):
    return events.select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("p.k").alias("k"))).alias("merged"))


@query("chart_metrics", """
SELECT chart_id, TRY_CAST(CASE WHEN replace(replace(spotify_streams, ',', ''), ' ', '') NOT IN ('N/A', '', 'nan') THEN replace(replace(spotify_streams, ',', ''), ' ', '') END AS DOUBLE) AS streams,
  TRY_CAST(CASE WHEN spotify_playlist_reach <> 'N/A' THEN spotify_playlist_reach END AS DOUBLE) AS reach,
  TRY_CAST(nullif(replace(youtube_views, ',', ''), '') AS DOUBLE) AS views, nullif(spotify_playlist_reach, 'N/A') AS reach_text,
  least(greatest(CAST(spotify_popularity AS DOUBLE), 0), 100) AS popularity,
  CASE WHEN CAST(spotify_popularity AS DOUBLE) BETWEEN 0 AND 100 THEN CAST(spotify_popularity AS DOUBLE) END AS valid_popularity,
  CASE WHEN coalesce(TRY_CAST(nullif(replace(youtube_views, ',', ''), '') AS DOUBLE), 0) > 0 THEN round(CAST(youtube_likes AS DOUBLE) / TRY_CAST(nullif(replace(youtube_views, ',', ''), '') AS DOUBLE), 6) ELSE 0 END AS like_rate,
  round(ln(1 + CAST(youtube_likes AS DOUBLE)), 6) AS log_likes FROM chart_metrics""")
def prj6_prj7_prj11_flt4_flt5_num8_num9_messy_numbers(chart_metrics):
    views, likes, popularity = N.messy_number(F.col("youtube_views")), N.to_number(F.col("youtube_likes")), N.to_number(F.col("spotify_popularity"))
    return chart_metrics.select(
        "chart_id", N.messy_number(F.col("spotify_streams")).alias("streams"), N.messy_number(F.col("spotify_playlist_reach")).alias("reach"), views.alias("views"),
        N.null_tokens(F.col("spotify_playlist_reach")).alias("reach_text"), N.clip(popularity, 0, 100).alias("popularity"), N.within(popularity, 0, 100).alias("valid_popularity"),
        F.round(N.safe_ratio(likes, F.coalesce(views, F.lit(0.0))), 6).alias("like_rate"), F.round(F.log1p(likes), 6).alias("log_likes"))


@query("stream_users", """
SELECT trim(user_id) AS user_id, CAST(trim(replace(engagement_pct, '%', '')) AS DOUBLE) AS engagement, lower(subscription) IN ('true', '1', 'yes', 'premium') AS paid,
  lower(trim(platform)) AS platform, CASE lower(trim(country)) WHEN 'usa' THEN 'United States' WHEN 'uk' THEN 'United Kingdom' WHEN 'south korea' THEN 'Korea' ELSE trim(country) END AS country
FROM stream_users WHERE trim(user_id) <> '' AND length(trim(platform)) >= 3 AND top_genre IS NOT NULL""")
def flt1_flt3_prj8_prj9_users(stream_users):
    kept = stream_users.where(tables.not_blank("user_id")).where(F.char_length(F.trim("platform")) >= 3).na.drop(how="any", subset=["top_genre"])
    paid = F.when(F.lower("subscription") == "premium", F.lit("yes")).otherwise(F.col("subscription"))
    country = F.when(F.lower(F.trim("country")) == "usa", "United States").when(F.lower(F.trim("country")) == "uk", "United Kingdom").when(F.lower(F.trim("country")) == "south korea", "Korea").otherwise(F.trim("country"))
    return kept.select(F.trim("user_id").alias("user_id"), N.percent_number(F.col("engagement_pct")).alias("engagement"), N.flexible_boolean(paid).alias("paid"), F.lower(F.trim("platform")).alias("platform"), country.alias("country"))


@query("tracks", """
SELECT rec_id,
  CASE WHEN tempo > 0 AND tempo <= 80 THEN 'slow' WHEN tempo > 80 AND tempo <= 120 THEN 'mid' WHEN tempo > 120 AND tempo <= 300 THEN 'fast' END AS tempo_bin,
  CASE WHEN valence >= 0 AND valence <= 0.33 THEN 'low' WHEN valence > 0.33 AND valence <= 0.66 THEN 'mid' WHEN valence > 0.66 AND valence <= 1 THEN 'high' END AS valence_bin,
  CASE WHEN energy IS NULL THEN 'unknown' WHEN energy >= 0.8 THEN 'viral' WHEN energy >= 0.6 THEN 'popular' WHEN energy >= 0.4 THEN 'moderate' ELSE 'niche' END AS tier,
  round((tempo - 50) / 200, 6) AS tempo_scaled, round(tempo / 60000, 6) AS per_ms, CAST(floor(tempo / 10) * 10 AS BIGINT) AS decade,
  round(energy * danceability, 6) AS drive, round((energy + valence) / 2, 6) AS mood,
  coalesce(energy > 0.7 AND valence > 0.5, false) AS is_upbeat, coalesce(acousticness > 0.7, false) AS is_acoustic,
  CASE WHEN energy >= 0.5 AND valence >= 0.5 THEN 'happy' WHEN energy >= 0.5 THEN 'angry' WHEN valence >= 0.5 THEN 'calm' WHEN energy < 0.5 THEN 'sad' END AS quadrant,
  round((CAST(energy IS NOT NULL AS INT) + CAST(danceability IS NOT NULL AS INT) + CAST(popularity_score IS NOT NULL AS INT)) / 3.0, 6) AS complete,
  CASE WHEN energy IS NOT NULL AND danceability IS NOT NULL THEN round(greatest(0, least(100, energy * danceability * 150)), 6) END AS clamped FROM tracks""")
def num1_num16_derived_columns(tracks):
    e, d, v, t = (F.col(c) for c in ("energy", "danceability", "valence", "tempo"))
    false = F.lit(False)
    return tracks.select(
        "rec_id", N.cut_bins(t, [0, 80, 120, 300], ["slow", "mid", "fast"]).alias("tempo_bin"), N.cut_bins(v, [0, 0.33, 0.66, 1], ["low", "mid", "high"], include_lowest=True).alias("valence_bin"),
        N.tiers(e, [(0.8, "viral"), (0.6, "popular"), (0.4, "moderate")], "niche").alias("tier"), F.round(N.min_max(t, 50, 250), 6).alias("tempo_scaled"), F.round(t / 60000, 6).alias("per_ms"),
        (F.floor(t / 10) * 10).alias("decade"), F.round(e * d, 6).alias("drive"), F.round((e + v) / 2, 6).alias("mood"), F.coalesce((e > 0.7) & (v > 0.5), false).alias("is_upbeat"),
        F.coalesce(F.col("acousticness") > 0.7, false).alias("is_acoustic"),
        F.when((e >= 0.5) & (v >= 0.5), "happy").when(e >= 0.5, "angry").when(v >= 0.5, "calm").when(e < 0.5, "sad").alias("quadrant"),
        F.round(N.completeness(e, d, F.col("popularity_score")), 6).alias("complete"), F.round(F.when(e.isNull() | d.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), e * d * 150))), 6).alias("clamped"))


@query("social_trends", """
SELECT event_id, year(start_date) AS y, month(start_date) AS m, quarter(start_date) AS q, dayname(start_date) AS day_name,
  CAST(floor((epoch(end_date) - epoch(start_date)) / 86400) AS BIGINT) AS days,
  CASE WHEN floor((epoch(end_date) - epoch(start_date)) / 86400) <= 7 THEN 'short' WHEN floor((epoch(end_date) - epoch(start_date)) / 86400) <= 30 THEN 'weeks'
       WHEN floor((epoch(end_date) - epoch(start_date)) / 86400) <= 90 THEN 'months' ELSE 'long' END AS span FROM social_trends""")
def dat1_dat2_date_parts(social_trends):
    days = N.elapsed_days(F.col("start_date").cast("timestamp"), F.col("end_date").cast("timestamp"))
    span = N.cut_bins(days, [float("-inf"), 7, 30, 90, float("inf")], ["short", "weeks", "months", "long"], include_lowest=True)
    return social_trends.select("event_id", F.year("start_date").alias("y"), F.month("start_date").alias("m"), F.quarter("start_date").alias("q"), F.date_format("start_date", "EEEE").alias("day_name"), days.alias("days"), span.alias("span"))


@query("social_trends", """
SELECT min(start_date) AS first_start, max(end_date) AS last_end, CAST(date_diff('day', CAST(min(start_date) AS DATE), CAST(max(end_date) AS DATE)) AS INT) AS days,
  count(*) FILTER (WHERE end_date < start_date) AS negative, count(*) FILTER (WHERE epoch(end_date) - epoch(start_date) > 365 * 86400) AS very_long, count(*) FILTER (WHERE year(start_date) < 2010) AS too_early,
  CAST(greatest(0, 100 - 2 * date_diff('day', CAST(max(start_date) AS DATE), DATE '2026-01-01')) AS DOUBLE) AS freshness FROM social_trends""")
def dat3_dat4_flt10_date_sanity(social_trends):
    seconds = F.unix_timestamp(F.col("end_date").cast("timestamp")) - F.unix_timestamp(F.col("start_date").cast("timestamp"))
    age = F.datediff(F.lit("2026-01-01").cast("date"), F.to_date(F.max("start_date")))
    return social_trends.agg(
        F.min("start_date").alias("first_start"), F.max("end_date").alias("last_end"), F.datediff(F.to_date(F.max("end_date")), F.to_date(F.min("start_date"))).alias("days"),
        F.count_if(F.col("end_date") < F.col("start_date")).alias("negative"), F.count_if(seconds > 365 * 86400).alias("very_long"), F.count_if(F.year("start_date") < 2010).alias("too_early"),
        F.greatest(F.lit(0.0), 100 - 2 * age.cast("double")).alias("freshness"))


@query("orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def prj10_parse_dates(orders):
    texts = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("t"))
    return texts.select("o_orderkey", F.to_date(N.any_date(F.col("t"))).alias("d"))


@query("tracks", "SELECT track_name AS track, artist_name AS artist, CAST(NULL AS VARCHAR) AS isrc, 'spotify_main' AS source_dataset, 2 AS source_priority FROM tracks WHERE source_dataset = 'spotify_main'")
def prj1_prj5_prj12_standardize(tracks):
    source = tracks.where("source_dataset = 'spotify_main'").withColumnsRenamed({"track_name": "Track_Name", "artist_name": "ARTIST"})
    named = tables.standardize(source, {"track": ["title", "track_name"], "artist": ["artist", "artists"], "isrc": ["isrc"]})
    return tables.with_provenance(named, "spotify_main", 2, ["track", "artist"]).drop("row_key")


@query("tracks", "SELECT rec_id, track_name AS title, genre, 0.5 AS platform_popularity FROM tracks")
def prj3_prj5_prj13_rename_and_select(tracks):
    named = tables.rename(tracks, {"track_name": "title"})
    return tables.select_present(tables.with_defaults(named, {"platform_popularity": 0.5}), ["rec_id", "title", "genre", "not_there", "platform_popularity"])


_GENRES = ("country", "electronic", "hip hop", "jazz", "pop", "rock", "unknown")
_TIER = "CASE WHEN normalized_popularity IS NULL THEN 'unknown' WHEN normalized_popularity >= 60 THEN 'high' WHEN normalized_popularity >= 20 THEN 'medium' ELSE 'low' END"


@query("songs", f"""
SELECT rec_id, CASE WHEN spotify THEN 'spotify' WHEN youtube THEN 'youtube' WHEN tiktok THEN 'tiktok' ELSE 'unknown' END AS primary_platform,
  CAST(spotify AS INT) + CAST(tiktok AS INT) + CAST(youtube AS INT) AS platform_count, (CAST(spotify AS INT) + CAST(tiktok AS INT) + CAST(youtube AS INT)) > 1 AS multi,
  CAST(dense_rank() OVER (ORDER BY genre) - 1 AS INT) AS genre_code, {', '.join(f"CAST(genre = '{g}' AS INT) AS " + '"genre_' + g + '"' for g in _GENRES)},
  {', '.join(f"CAST({_TIER} = '{t}' AS INT) AS tier_{t}" for t in ("high", "medium", "low", "unknown"))} FROM songs""")
def enc1_enc4_encodings(songs):
    tier = N.tiers(F.col("normalized_popularity"), [(60, "high"), (20, "medium")], "low")
    coded = tables.one_hot(tables.one_hot(tables.label_encode(songs.withColumn("tier", tier), "genre", "genre_code"), "genre"), "tier", ["high", "medium", "low", "unknown"])
    count = F.col("spotify").cast("int") + F.col("tiktok").cast("int") + F.col("youtube").cast("int")
    return coded.select(
        "rec_id", F.when(F.col("spotify"), "spotify").when(F.col("youtube"), "youtube").when(F.col("tiktok"), "tiktok").otherwise("unknown").alias("primary_platform"),
        count.alias("platform_count"), (count > 1).alias("multi"), "genre_code", *[F.col(f"`{c}`") for c in coded.columns if c.startswith(("genre_", "tier_")) and c != "genre_code"])


@query("songs", "SELECT rec_id, energy, danceability FROM songs WHERE energy IS NOT NULL AND danceability IS NOT NULL")
def flt2_complete_rows(songs):
    return tables.drop_incomplete(songs, ["energy", "danceability"]).select("rec_id", "energy", "danceability")


@query("tracks", """
WITH e AS (SELECT min(popularity_score) lo, max(popularity_score) hi FROM tracks)
SELECT rec_id, CASE WHEN popularity_score IS NULL THEN NULL ELSE CAST(least(greatest(ceil((popularity_score - lo) / ((hi - lo) / 3)), 1), 3) AS INT) END AS bin,
  round((log10(CASE WHEN coalesce(popularity_score, 0) = 0 THEN 1 ELSE popularity_score END)), 6) AS log_score FROM tracks, e""")
def num3_num6_auto_bins(tracks):
    ends = tracks.agg(F.min("popularity_score").alias("lo"), F.max("popularity_score").alias("hi"))
    value = F.col("popularity_score")
    return tracks.crossJoin(F.broadcast(ends)).select(
        "rec_id", F.when(value.isNotNull(), N.equal_width_bin(value, F.col("lo"), F.col("hi"), 3)).alias("bin"),
        F.round(F.log10(F.when(F.coalesce(value, F.lit(0.0)) == 0, 1.0).otherwise(value)), 6).alias("log_score"))


@query("chart_metrics", """
SELECT chart_id FROM chart_metrics WHERE (CAST(spotify_popularity AS DOUBLE) > 95 OR CAST(youtube_likes AS DOUBLE) > 38) AND CAST(spotify_popularity AS DOUBLE) + CAST(youtube_likes AS DOUBLE) > 0""")
def flt6_flt7_activity(chart_metrics):
    popularity, likes = N.to_number(F.col("spotify_popularity")), N.to_number(F.col("youtube_likes"))
    return chart_metrics.where((popularity > 95) | (likes > 38)).where(popularity + likes > 0).select("chart_id")


@query("social_trends", "SELECT DISTINCT platform FROM social_trends WHERE platform NOT IN ('IG', 'tiktok', 'Instagram  Reels', 'snap!')")
def flt9_set4_unknown_platforms(social_trends):
    return tables.unknown_values(social_trends, "platform", ["IG", "tiktok", "Instagram  Reels", "snap!"])


_COLUMNS = ("rec_id", "source_dataset", "source_priority", "track_name", "artist_name", "genre", "danceability", "energy", "valence", "acousticness", "instrumentalness", "liveness", "speechiness", "tempo", "loudness", "popularity_score", "observed_at")


@query("tracks", f"""
SELECT 'isrc' AS "column", 'missing' AS state, NULL AS rows
UNION ALL SELECT c, 'extra', NULL FROM (SELECT unnest([{', '.join(f"'{c}'" for c in _COLUMNS)}]) AS c) WHERE c NOT IN ('rec_id', 'track_name')
UNION ALL SELECT 'energy', CASE WHEN any_value(typeof(energy)) IN ('DOUBLE', 'FLOAT', 'INTEGER', 'BIGINT') THEN 'PASS' ELSE 'FAIL' END, NULL FROM tracks
UNION ALL SELECT 'genre', CASE WHEN any_value(typeof(genre)) = 'VARCHAR' THEN 'PASS' ELSE 'FAIL' END, NULL FROM tracks
UNION ALL SELECT 'tempo', CASE WHEN any_value(typeof(tempo)) = 'VARCHAR' THEN 'PASS' ELSE 'FAIL' END, NULL FROM tracks
UNION ALL SELECT 'tracks', 'energy,tempo / pitch', count(*) FROM tracks""")
def flt11_prj4_val17_val24_schema_checks(tracks):
    wanted = tables.column_check(tables.drop_repeated_columns(tracks), ["rec_id", "track_name", "isrc"])
    typed = tables.type_check(tracks, {"energy": "numeric", "genre": "string", "tempo": "string"})
    shapes = tables.shape({"tracks": tracks}, ["energy", "tempo", "pitch"])
    none = F.lit(None).cast("long").alias("rows")
    return tables.union_all(wanted.select("column", "state", none), typed.select("column", "state", none), shapes.select(F.col("dataset").alias("column"), F.concat("present", F.lit(" / "), "missing").alias("state"), "rows"))
