"""Catalog-shaped views over the TPC-H-style tables, as SQL that Spark and DuckDB both accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "tracks": """
SELECT
  CONCAT(CAST(l.l_orderkey AS STRING), '-', CAST(l.l_linenumber AS STRING), '-', CAST(l.l_partkey AS STRING), '-', CAST(l.l_suppkey AS STRING)) AS rec_id,
  CASE l.l_orderkey % 6 WHEN 0 THEN 'music_info' WHEN 1 THEN 'spotify_main'
       WHEN 2 THEN 'spotify_secondary' WHEN 3 THEN 'youtube'
       WHEN 4 THEN 'tiktok_2021' ELSE 'tiktok_2022' END         AS source_dataset,
  CAST(l.l_orderkey % 6 + 1 AS INT)                             AS source_priority,
  CONCAT(p.p_name, ' ', CAST(l.l_partkey AS STRING),
    CASE l.l_orderkey % 5 WHEN 1 THEN ' (Radio Edit)' WHEN 2 THEN ' [Live]'
         WHEN 3 THEN ' feat. Guest' ELSE '' END)                AS track_name,
  CONCAT(CASE WHEN l.l_orderkey % 4 = 1 THEN 'The ' ELSE '' END, s.s_name) AS artist_name,
  CASE WHEN l.l_orderkey % 13 = 0 THEN 'unknown' ELSE
    CASE p.p_size % 6 WHEN 0 THEN 'pop' WHEN 1 THEN 'rock' WHEN 2 THEN 'hip hop'
         WHEN 3 THEN 'electronic' WHEN 4 THEN 'country' ELSE 'jazz' END END AS genre,
  CASE WHEN l.l_orderkey % 17 = 0 THEN NULL ELSE CAST((l.l_partkey*37 + l.l_orderkey) % 101 AS DOUBLE)/100 END AS danceability,
  CASE WHEN l.l_orderkey % 19 = 0 THEN NULL ELSE CAST((l.l_partkey*53 + l.l_orderkey) % 101 AS DOUBLE)/100 END AS energy,
  CAST((l.l_partkey*29 + l.l_orderkey) % 101 AS DOUBLE)/100     AS valence,
  CAST((l.l_partkey*71 + l.l_orderkey) % 101 AS DOUBLE)/100     AS acousticness,
  CAST((l.l_partkey*13 + l.l_orderkey) % 101 AS DOUBLE)/100     AS instrumentalness,
  CAST((l.l_partkey*17 + l.l_orderkey) % 101 AS DOUBLE)/100     AS liveness,
  CAST((l.l_partkey*7  + l.l_orderkey) % 101 AS DOUBLE)/200     AS speechiness,
  CAST(40 + (l.l_partkey*31 + l.l_orderkey) % 230 AS DOUBLE)    AS tempo,
  CAST(-65 + (l.l_partkey*11 + l.l_orderkey) % 70 AS DOUBLE)    AS loudness,
  CASE WHEN l.l_orderkey % 6 = 0 THEN NULL WHEN l.l_orderkey % 6 = 3 THEN l.l_extendedprice * 1000
       ELSE l.l_quantity * 2 END                                AS popularity_score,
  l.l_shipdate                                                  AS observed_at
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
""",
    "stream_users": """
SELECT CASE WHEN c_custkey % 29 = 0 THEN ' ' ELSE CONCAT(' U', CAST(c_custkey % 140 AS STRING)) END AS user_id,
  CAST(5 + c_custkey % 110 AS STRING)                            AS age,
  CASE c_nationkey % 5 WHEN 0 THEN 'usa' WHEN 1 THEN ' UK' WHEN 2 THEN 'south korea'
       WHEN 3 THEN 'russia' ELSE 'Brazil ' END                   AS country,
  CASE c_custkey % 4 WHEN 0 THEN 'Spotify' WHEN 1 THEN 'apple music'
       WHEN 2 THEN 'TIDAL ' ELSE 'Other' END                     AS platform,
  c_mktsegment                                                   AS top_genre,
  CASE WHEN c_custkey % 11 = 0 THEN 'n/a' ELSE CAST(CAST(FLOOR(c_acctbal) AS BIGINT) AS STRING) END AS minutes_per_day,
  CONCAT(CAST(c_custkey % 130 AS STRING), '%')                   AS engagement_pct,
  CASE c_custkey % 6 WHEN 0 THEN 'premium' WHEN 1 THEN 'Free' WHEN 2 THEN 'student'
       WHEN 3 THEN 'family' WHEN 4 THEN 'trial' ELSE 'gold' END  AS subscription
FROM customer
""",
    "social_trends": """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'IG' WHEN 1 THEN 'snap!' WHEN 2 THEN 'Instagram  Reels'
       WHEN 3 THEN 'tiktok' ELSE 'myspace' END                   AS platform,
  CASE event_type WHEN 'click' THEN 'Dance Challenge' WHEN 'view' THEN 'filters'
       WHEN 'error' THEN 'nan' ELSE event_type END               AS trend_type,
  CASE event_id % 4 WHEN 0 THEN 'Hip-Hop' WHEN 1 THEN 'EDM' WHEN 2 THEN 'none' ELSE 'Pop Music' END AS genre,
  CONCAT('Trend #', CAST(user_id AS STRING), '!')                AS trend_description,
  ts                                                             AS start_date,
  CASE event_id % 6 WHEN 0 THEN ts - INTERVAL '2' DAY WHEN 1 THEN ts + INTERVAL '5' DAY
       WHEN 2 THEN ts + INTERVAL '20' DAY WHEN 3 THEN ts + INTERVAL '60' DAY
       WHEN 4 THEN ts + INTERVAL '200' DAY ELSE ts + INTERVAL '400' DAY END AS end_date
FROM events
""",
    "chart_metrics": """
SELECT o_orderkey AS chart_id,
  CONCAT(CAST(o_custkey + 1 AS STRING), ',', CAST(100 + o_orderkey % 900 AS STRING)) AS spotify_streams,
  CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE CAST(o_orderkey % 500 AS STRING) END  AS spotify_playlist_reach,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CONCAT(CAST(o_orderkey % 90 AS STRING), ',000') END AS youtube_views,
  CAST(o_orderkey % 40 AS STRING)                                AS youtube_likes,
  CAST(o_orderkey % 130 AS STRING)                               AS spotify_popularity,
  CASE WHEN o_orderdate < TIMESTAMP '1995-07-01' THEN '2021' ELSE '2022' END AS source_year
FROM orders
""",
    "song_status": """
SELECT user_id AS song_id, event_id AS seq, ts AS status_ts,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed'
       WHEN 'error' THEN 'failed' ELSE 'processing' END          AS processing_status
FROM events
""",
}


VIEWS["songs"] = f"""
SELECT rec_id, source_dataset, source_priority, track_name, artist_name, genre, danceability, energy, valence, acousticness,
  instrumentalness, liveness, speechiness, tempo, loudness, observed_at,
  source_dataset LIKE '%spotify%' AS spotify, source_dataset LIKE '%tiktok%' AS tiktok, source_dataset LIKE '%youtube%' AS youtube,
  CASE WHEN source_dataset LIKE '%spotify%' THEN 'spotify' WHEN source_dataset LIKE '%tiktok%' THEN 'tiktok'
       WHEN source_dataset LIKE '%youtube%' THEN 'youtube' ELSE 'catalog' END AS platform,
  CAST(FLOOR(tempo) AS INT) % 5 + 1 AS source_count,
  popularity_score AS avg_popularity,
  LEAST(GREATEST(popularity_score, 0.0), 100.0) AS normalized_popularity
FROM ({VIEWS["tracks"].strip()}) t
"""

VIEWS["raw_tracks"] = f"""
SELECT rec_id AS row_id,
  CASE WHEN tempo > 265 THEN ' ' WHEN tempo < 42 THEN NULL ELSE CONCAT(' ', track_name, '/', artist_name) END AS track_id,
  CASE WHEN valence = 0.25 THEN 'nan' WHEN source_priority = 2 THEN CONCAT(artist_name, ', Guest; Choir feat. Band') ELSE CONCAT(artist_name, ' ') END AS artists,
  source_dataset AS album_name,
  CASE WHEN acousticness = 0.5 THEN ' ' WHEN acousticness = 0.51 THEN 'None' ELSE CONCAT(' ', track_name) END AS track_name,
  CASE WHEN popularity_score IS NULL THEN 'n/a' ELSE CAST(CAST(FLOOR(popularity_score) AS BIGINT) AS STRING) END AS popularity,
  CASE WHEN valence < 0.05 THEN NULL ELSE CAST(CAST(FLOOR(tempo * tempo * 30) AS BIGINT) AS STRING) END AS duration_ms,
  CASE WHEN valence < 0.3 THEN 'True' WHEN valence < 0.6 THEN 'no' WHEN valence < 0.9 THEN '1' END AS explicit,
  danceability * 1.05 AS danceability, energy, valence, acousticness, instrumentalness, liveness, speechiness, tempo, loudness,
  CASE WHEN liveness > 0.9 THEN NULL ELSE CAST(FLOOR(acousticness * 14) AS INT) END AS key,
  CASE WHEN liveness < 0.1 THEN NULL ELSE CAST(FLOOR(energy * 2) AS INT) END AS mode,
  CASE WHEN valence > 0.95 THEN NULL ELSE CAST(FLOOR(speechiness * 18) AS INT) END AS time_signature,
  CASE WHEN valence = 0.5 THEN 'Acid Jazz ' WHEN valence = 0.51 THEN 'spoken word' WHEN genre = 'unknown' THEN 'nan' ELSE CONCAT(' ', UPPER(genre)) END AS track_genre,
  CASE WHEN valence > 0.8 THEN NULL ELSE CONCAT('Chart, ', genre, ',', source_dataset) END AS tags,
  CAST(CAST(FLOOR(tempo) AS INT) + 1800 AS STRING) AS year,
  CASE source_dataset WHEN 'tiktok_2021' THEN '2021' WHEN 'tiktok_2022' THEN '2022' END AS source_year
FROM ({VIEWS["tracks"].strip()}) t
"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS``, or a table itself."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for table in TABLES:
        if f" {table} " in VIEWS[name].replace("\n", " ") + " ":
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(VIEWS[name])


def sql_over(names: tuple[str, ...], query: str) -> str:
    """``query`` with the views it names as common table expressions."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    head = query.lstrip()
    return f"WITH {ctes}, {head[5:]}" if head.upper().startswith("WITH ") else f"WITH {ctes}\n{head}"
