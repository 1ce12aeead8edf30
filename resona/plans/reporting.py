"""Queries over composed reports, personas and audience strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from resona.operators import insights, models, reports, scores, tables
from resona.plans.query import query
from resona.plans.scoring import _AR, _align, val15_quality_summary

_SOUND = ["danceability", "energy", "valence"]


def _entries(section: str, place: str, item: str, source: str, values: list[str], texts: tuple = ()) -> str:
    """SQL for one section of a report; ``source`` names a common table expression."""
    one = [f"SELECT '{section}' AS section, CAST({place} AS INT) AS place, CAST({item} AS VARCHAR) AS item, '{v}' AS measure, round(CAST({v} AS DOUBLE), 4) AS value, CAST(NULL AS VARCHAR) AS text FROM {source}" for v in values]
    two = [f"SELECT '{section}', CAST({place} AS INT), CAST({item} AS VARCHAR), '{t}', CAST(NULL AS DOUBLE), CAST({t} AS VARCHAR) FROM {source}" for t in texts]
    return " UNION ALL ".join(one + two)


_SCORES = {"commercial_potential": "commercial", "musical_quality": "musical", "market_fit": "market", "uniqueness": "uniq", "scalability": "scalable"}


@query("songs", _AR + f""", z AS (SELECT rec_id, track_name, artist_name, genre, normalized_popularity, round(score, 4) AS ar_score, {', '.join(f'{b} AS {a}' for a, b in _SCORES.items())} FROM ar),
a AS (SELECT *, CASE WHEN avg_ar_score >= 75 THEN CASE WHEN pop >= 70 THEN 'Established Hit-Maker' ELSE 'High Potential Emerging' END WHEN avg_ar_score >= 60 THEN CASE WHEN consistency >= 80 THEN 'Consistent Performer' ELSE 'Variable Quality' END
    WHEN max_ar_score >= 80 THEN 'One Hit Wonder Potential' ELSE 'Development Needed' END AS category, row_number() OVER (ORDER BY avg_ar_score DESC, artist_name) AS place
  FROM (SELECT artist_name, count(*) AS track_count, avg(ar_score) AS avg_ar_score, max(ar_score) AS max_ar_score, 100 - stddev_samp(ar_score) AS consistency, avg(normalized_popularity) AS pop FROM z GROUP BY 1 HAVING count(*) >= 2) QUALIFY place <= 20),
t AS (SELECT *, row_number() OVER (ORDER BY ar_score DESC, rec_id) AS place FROM z QUALIFY place <= 20),
g AS (SELECT *, row_number() OVER (ORDER BY opportunity_score DESC, genre) AS place FROM (SELECT genre, track_count, market_saturation, greatest(0, (100 - market_saturation) * 0.4 + avg_ar * 0.3 + (trend - 0.5) * 100 * 0.3) AS opportunity_score
  FROM (SELECT genre, count(*) AS track_count, avg(ar_score) AS avg_ar, count(*) * 100.0 / (SELECT count(*) FROM z) AS market_saturation,
    CASE lower(genre) {' '.join(f"WHEN '{n}' THEN {w}" for n, (w, _) in scores.GENRE_TRENDS.items())} ELSE 1.0 END AS trend FROM z WHERE genre <> 'unknown' GROUP BY genre HAVING count(*) >= 10)) QUALIFY place <= 20),
y AS (SELECT count(*) AS dataset_size, count(DISTINCT artist_name) AS unique_artists, round(avg(ar_score), 2) AS avg_ar_score, count(*) FILTER (WHERE ar_score >= 70) AS high_potential_tracks, (SELECT count(*) FROM a WHERE avg_ar_score >= 60) AS promising_artists_count FROM z)
{_entries('summary', '1', "'all'", 'y', ['dataset_size', 'unique_artists', 'avg_ar_score', 'high_potential_tracks', 'promising_artists_count'])}
UNION ALL {_entries('promising_artists', 'place', 'artist_name', 'a', ['track_count', 'avg_ar_score', 'max_ar_score', 'consistency'], ('category',))}
UNION ALL {_entries('top_tracks', 'place', 'rec_id', 't', ['ar_score', *_SCORES, 'normalized_popularity'], ('track_name', 'artist_name', 'genre'))}
UNION ALL {_entries('market_opportunities', 'place', 'genre', 'g', ['track_count', 'market_saturation', 'opportunity_score'])}""")
def sc16_ar_report(songs):
    return reports.ar_sections(scores.with_ar_scores(songs, digits=4))


@query("songs", f"""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY track_name, artist_name ORDER BY source_priority, rec_id, avg_popularity) AS n FROM songs QUALIFY n = 1),
o AS (SELECT round(0.7 * c + 0.3 * least(10 * s, 30), 2) AS overall FROM (SELECT (count(energy) + count(danceability) + count(genre)) / (3.0 * count(*)) * 100 AS c, count(DISTINCT source_dataset) AS s FROM songs)),
f AS (SELECT count(*) AS total_unique_tracks, (SELECT count(DISTINCT source_dataset) FROM songs) AS source_datasets, count(*) FILTER (WHERE source_count > 1) AS multi_source_tracks, count(*) FILTER (WHERE abs(avg_popularity - normalized_popularity) > 30) AS outliers,
  (SELECT overall FROM o) AS overall, {', '.join(f'round(count({c}) * 100.0 / count(*), 2) AS {c}' for c in _SOUND)} FROM m),
x AS (SELECT count(*) AS mixed FROM (SELECT 1 FROM songs WHERE genre <> 'unknown' GROUP BY track_name, artist_name HAVING min(genre) <> max(genre))),
c AS (UNPIVOT (SELECT {', '.join(_SOUND)} FROM f) ON {', '.join(_SOUND)} INTO NAME feature VALUE percent),
s AS (SELECT source_dataset, count(*) AS total_records, min(source_priority) AS priority, {', '.join(f'round(count({c}) * 100.0 / count(*), 2) AS {c}' for c in _SOUND)} FROM songs GROUP BY 1),
p AS (SELECT s.*, coalesce(k, 0) AS contribution_to_master FROM s LEFT JOIN (SELECT source_dataset, count(*) AS k FROM m GROUP BY 1) USING (source_dataset)),
r AS (SELECT 'Data Quality' AS category, 'High' AS priority, 'Overall data quality is below 70%. Consider improving data collection processes.' AS recommendation FROM f WHERE overall < 70
  UNION ALL SELECT 'Data Completeness', 'Medium', concat(feature, ' is only ', percent, '% complete. Consider additional data sources or imputation strategies.') FROM c WHERE percent < 80
  UNION ALL SELECT 'Data Consistency', 'Medium', concat('Found ', outliers, ' songs with inconsistent popularity across platforms. Review normalization methods.') FROM f WHERE outliers > 10
  UNION ALL SELECT 'Genre Mapping', 'Low', concat(mixed, ' songs have inconsistent genre assignments. Consider genre standardization.') FROM x WHERE mixed > 50)
{_entries('executive_summary', '1', "'all'", 'f', ['total_unique_tracks', 'source_datasets', 'multi_source_tracks', 'overall'])}
UNION ALL {_entries('data_completeness', '1', 'feature', 'c', ['percent'])}
UNION ALL {_entries('data_sources', 'priority', 'source_dataset', 'p', ['total_records', 'contribution_to_master', *_SOUND])}
UNION ALL {_entries('recommendations', '1', 'category', 'r', [], ('priority', 'recommendation'))}""")
def val26_integration_report(songs):
    needed = songs.select("track_name", "artist_name", "source_priority", "rec_id", "source_dataset", "source_count", "avg_popularity", "normalized_popularity", *_SOUND)
    masters = tables.first_row(needed, ["track_name", "artist_name"], ["source_priority", "rec_id", "avg_popularity"]).withColumnRenamed("source_dataset", "primary_source")
    return reports.integration_sections(masters, songs, val15_quality_summary(songs), _SOUND)


_VIRAL = "(max(avg_popularity) / 100 * 0.4 + avg(avg_popularity) / 100 * 0.3 + count(avg_popularity) / 3.0 * 0.3) * 100"


@query("songs", f"""
WITH l AS (SELECT *, source_priority - 1 AS cluster FROM songs), v AS (SELECT track_name, artist_name, {_VIRAL} AS score FROM songs GROUP BY ALL),
w AS (SELECT cluster, avg(score) AS score FROM (SELECT DISTINCT cluster, track_name, artist_name FROM l) JOIN v USING (track_name, artist_name) GROUP BY 1),
p AS (SELECT cluster, string_agg(platform || ':' || n, ',' ORDER BY n DESC, platform) AS platforms FROM (SELECT cluster, platform, count(*) AS n FROM l GROUP BY ALL) GROUP BY 1),
f AS (SELECT cluster, count(*) AS size, round(count(*) * 100.0 / (SELECT count(*) FROM l), 6) AS percentage, {', '.join(f'round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std' for c in _SOUND)} FROM l GROUP BY 1)
SELECT f.*, {str(list(models.PERSONA_NAMES))}[cluster + 1] AS persona, round(coalesce(score, 0), 6) AS avg_virality, platforms FROM f LEFT JOIN w USING (cluster) LEFT JOIN p USING (cluster)""")
def ml15_personas(songs):
    """Personas of given labels: the source of a row is its cluster."""
    labelled = songs.withColumn("cluster", F.col("source_priority") - 1)
    viral = scores.virality(songs.withColumn("popularity_score", F.col("avg_popularity")), ("track_name", "artist_name"))
    found = models.personas(labelled, _SOUND, viral, ("track_name", "artist_name"))
    figures = [F.round(f"{c}_{n}", 6).alias(f"{c}_{n}") for c in _SOUND for n in ("mean", "std")]
    shown = F.array_join(F.transform("platforms", lambda p: F.concat_ws(":", p["platform"], p["songs"].cast("string"))), ",")
    return found.select("cluster", "persona", "size", F.round("percentage", 6).alias("percentage"), *figures, F.round("avg_virality", 6).alias("avg_virality"), shown.alias("platforms"))


_AUDIENCES = {a: n for n in scores.RANGE_PROFILES for a in insights.AUDIENCE_STRATEGIES if a in n}


@query("songs", " UNION ALL ".join(
    f"SELECT '{a}' AS audience, round(avg({_align(scores.RANGE_PROFILES[n])}), 6) AS avg_alignment, " + ", ".join(f"'{'; '.join(t)}' AS {k}" for k, t in zip(("strategies", "platforms", "content"), insights.AUDIENCE_STRATEGIES[a], strict=True)) + " FROM songs"
    for a, n in _AUDIENCES.items()))
def ins12_audience_strategies(songs):
    aligned = {n: F.round(scores.range_alignment(p), 6) for n, p in scores.RANGE_PROFILES.items()}
    found = insights.audience_strategies(songs, aligned)
    return found.select("audience", F.round("avg_alignment", 6).alias("avg_alignment"), *[F.array_join(c, "; ").alias(c) for c in ("strategies", "platforms", "content")])
