"""Queries over imputation, popularity, scores and derived datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from resona.functions import numeric as N
from resona.functions import text as T
from resona.operators import catalog, matching, scores, stats, tables
from resona.plans.query import query

_QUALITY = """round((CAST(danceability IS NOT NULL AS INT) + CAST(energy IS NOT NULL AS INT) + CAST(valence IS NOT NULL AS INT) + CAST(acousticness IS NOT NULL AS INT) + CAST(instrumentalness IS NOT NULL AS INT)) / 5.0 * 40
  + CAST(normalized_popularity IS NOT NULL AS INT) * 20 + CAST(genre <> 'unknown' AS INT) * 15 + least((CAST(spotify AS INT) + CAST(tiktok AS INT) + CAST(youtube AS INT)) * 5, 15) + CAST(source_count > 1 AS INT) * 10, 1)"""


def _mean(*terms: str) -> str:
    """SQL for the mean of the terms that aren't null."""
    return f"(({' + '.join(f'coalesce({t}, 0)' for t in terms)}) / nullif({' + '.join(f'CAST(({t}) IS NOT NULL AS INT)' for t in terms)}, 0))"


def _fit(profile: dict, digits: int = 4) -> str:
    near = [f"CASE WHEN {f} IS NOT NULL THEN greatest(0.0, 1 - abs({f} - {float(v)}) / {100.0 if f == 'tempo' else 1.0}) END" for f, v in profile.items() if f != "weight"]
    return f"round(coalesce({_mean(*near)} * {float(profile.get('weight', 1.0))} * 100, 0), {digits})"


def _align(ranges: dict) -> str:
    fit = [f"CASE WHEN {f} IS NOT NULL THEN greatest(0.0, 1 - greatest({float(lo)} - {f}, {f} - {float(hi)}, 0.0)) END" for f, (lo, hi) in ranges.items()]
    return f"round(coalesce({_mean(*fit)}, 0), 6)"


_FITS = {**scores.AGE_PROFILES, **scores.PLATFORM_PROFILES, **scores.TREND_PROFILES}
_NAME = {n: n.split(" (")[0].lower().replace(" ", "_").replace("-", "_") for n in [*_FITS, *scores.RANGE_PROFILES]}
_AR = f"""
WITH q AS (SELECT *, {_QUALITY} AS dq FROM songs),
m AS (SELECT {', '.join(f'median({f}) AS m_{f}' for f in scores.UNIQUE_FEATURES)} FROM songs),
s AS (SELECT q.*,
  least((coalesce(least(normalized_popularity / 100, 1), 0) * 0.4 + (CAST(spotify AS INT) + CAST(tiktok AS INT) + CAST(youtube AS INT)) / 3.0 * 0.3 + coalesce({_mean('danceability', 'energy', 'valence')}, 0) * 0.3) * 100, 100) AS commercial,
  least((CASE WHEN loudness IS NULL THEN 0.5 WHEN loudness BETWEEN -14 AND -6 THEN 1.0 WHEN loudness BETWEEN -20 AND -14 OR loudness BETWEEN -6 AND 0 THEN 0.7 ELSE 0.4 END * 0.5
    + (CASE WHEN {_mean('acousticness', 'instrumentalness', 'speechiness')} IS NULL THEN 0.5 WHEN {_mean('acousticness', 'instrumentalness', 'speechiness')} BETWEEN 0.2 AND 0.6 THEN 1.0
       ELSE greatest(0.0, 1 - abs({_mean('acousticness', 'instrumentalness', 'speechiness')} - 0.4) * 2) END) * 0.25 + coalesce(dq / 100, 0.5) * 0.25) * 100, 100) AS musical,
  least((CASE lower(genre) {' '.join(f"WHEN '{g}' THEN coalesce(" + _mean(*[f'CASE WHEN {f} IS NOT NULL THEN greatest(0.0, 1 - abs({f} - ({float(v)})) / {20.0 if f == "loudness" else 1.0}) END' for f, v in fs.items()]) + f', 0.5) * {w}' for g, (w, fs) in scores.GENRE_TRENDS.items())} ELSE 0.5 END
    + CASE WHEN lower(genre) IN ('pop', 'hip hop', 'electronic') THEN 0.1 ELSE 0 END) * 100, 100) AS market,
  coalesce({_mean(*[f"CASE WHEN {f} IS NULL THEN NULL WHEN abs({f} - m_{f}) BETWEEN 0.1 AND 0.3 THEN 1.0 WHEN abs({f} - m_{f}) BETWEEN 0.05 AND 0.1 OR abs({f} - m_{f}) BETWEEN 0.3 AND 0.4 THEN 0.8 WHEN abs({f} - m_{f}) <= 0.05 THEN 0.3 ELSE 0.5 END" for f in scores.UNIQUE_FEATURES])} * 100, 50) AS uniq,
  (least(source_count / 5.0, 1) * 0.5 + (CAST(spotify AS INT) + CAST(tiktok AS INT) + CAST(youtube AS INT)) / 3.0 * 0.4 + dq / 100 * 0.1) * 100 AS scalable FROM q, m),
ar AS (SELECT *, commercial * 0.35 + musical * 0.25 + market * 0.20 + uniq * 0.15 + scalable * 0.05 AS score FROM s)
"""


@query("songs", f"SELECT rec_id, {_QUALITY} AS data_quality FROM songs")
def qs1_data_quality(songs):
    return songs.select("rec_id", scores.data_quality().alias("data_quality"))


@query("songs", f"SELECT rec_id, {', '.join(f'{_fit(p)} AS {_NAME[n]}' for n, p in _FITS.items())} FROM songs")
def sc1_sc2_sc3_ds11_profile_fits(songs):
    return songs.select("rec_id", *[F.round(scores.profile_fit(p, digits=4), 4).alias(_NAME[n]) for n, p in _FITS.items()])


@query("songs", f"SELECT rec_id, {', '.join(f'{_align(p)} AS {_NAME[n]}' for n, p in scores.RANGE_PROFILES.items())} FROM songs")
def sc4_range_alignment(songs):
    return songs.select("rec_id", *[F.round(scores.range_alignment(p), 6).alias(_NAME[n]) for n, p in scores.RANGE_PROFILES.items()])


@query("songs", _AR + "SELECT rec_id, round(commercial, 4) AS commercial_potential, round(musical, 4) AS musical_quality, round(market, 4) AS market_fit, round(uniq, 4) AS uniqueness, round(scalable, 4) AS scalability, round(score, 4) AS ar_score FROM ar")
def sc8_sc13_ar_scores(songs):
    scored = scores.with_ar_scores(songs, digits=4)
    return scored.select("rec_id", *[F.round(c, 4).alias(c) for c in (*scores.AR_WEIGHTS, "ar_score")])


@query("songs", _AR + """
, a AS (SELECT artist_name, count(*) AS track_count, avg(round(score, 4)) AS avg_ar, max(round(score, 4)) AS max_ar, 100 - stddev_samp(round(score, 4)) AS consistency, avg(normalized_popularity) AS pop,
  CAST(sum(CAST(spotify AS INT) + CAST(tiktok AS INT) + CAST(youtube AS INT)) AS BIGINT) AS platform_diversity, CAST(sum(source_count) AS BIGINT) AS total_sources FROM ar GROUP BY 1 HAVING count(*) >= 2)
SELECT artist_name, track_count, round(avg_ar, 4) AS avg_ar_score, round(max_ar, 4) AS max_ar_score, round(consistency, 4) AS consistency, platform_diversity, total_sources,
  CASE WHEN avg_ar >= 75 THEN CASE WHEN pop >= 70 THEN 'Established Hit-Maker' ELSE 'High Potential Emerging' END WHEN avg_ar >= 60 THEN CASE WHEN consistency >= 80 THEN 'Consistent Performer' ELSE 'Variable Quality' END
       WHEN max_ar >= 80 THEN 'One Hit Wonder Potential' ELSE 'Development Needed' END AS category FROM a ORDER BY avg_ar DESC, artist_name LIMIT 20""")
def sc14_sc16_promising_artists(songs):
    found = scores.promising_artists(scores.with_ar_scores(songs, digits=4))
    return found.select("artist_name", "track_count", *[F.round(c, 4).alias(c) for c in ("avg_ar_score", "max_ar_score", "consistency")], "platform_diversity", "total_sources", "category")


@query("songs", _AR + """
, g AS (SELECT genre, count(*) AS track_count, avg(round(score, 4)) AS avg_ar, count(*) FILTER (WHERE round(score, 4) >= 70) AS high_quality, count(*) FILTER (WHERE round(score, 4) >= 50 AND round(score, 4) < 70) AS medium_quality,
  count(*) * 100.0 / (SELECT count(*) FROM ar) AS sat, CASE lower(genre) WHEN 'pop' THEN 1.2 WHEN 'hip hop' THEN 1.1 WHEN 'electronic' THEN 1.1 WHEN 'rock' THEN 0.9 WHEN 'acoustic' THEN 0.8 ELSE 1.0 END AS trend FROM ar WHERE genre <> 'unknown' GROUP BY genre HAVING count(*) >= 10)
SELECT genre, track_count, high_quality, medium_quality, round(sat, 4) AS market_saturation, round(greatest(0, (100 - sat) * 0.4 + avg_ar * 0.3 + (trend - 0.5) * 100 * 0.3), 4) AS opportunity_score FROM g""")
def sc15_genre_opportunities(songs):
    found = scores.genre_opportunities(scores.with_ar_scores(songs, digits=4))
    return found.select("genre", "track_count", "high_quality", "medium_quality", F.round("market_saturation", 4).alias("market_saturation"), F.round("opportunity_score", 4).alias("opportunity_score"))


@query("songs", """
WITH g AS (SELECT track_name, artist_name, avg(normalized_popularity) AS mean, max(normalized_popularity) AS most, count(normalized_popularity) AS n, list_sort(list(DISTINCT platform)) AS platforms FROM songs GROUP BY ALL),
v AS (SELECT *, (most / 100 * 0.4 + mean / 100 * 0.3 + n / 3.0 * 0.3) * 100 AS score FROM g)
SELECT track_name, artist_name, platforms, round(score, 6) AS virality_score, CASE WHEN score > 0 AND score <= 20 THEN 'Low' WHEN score > 20 AND score <= 40 THEN 'Medium-Low' WHEN score > 40 AND score <= 60 THEN 'Medium'
  WHEN score > 60 AND score <= 80 THEN 'Medium-High' WHEN score > 80 AND score <= 100 THEN 'High' END AS virality_tier FROM v""")
def sc6_agg2_virality(songs):
    named = songs.withColumn("popularity_score", F.col("normalized_popularity"))
    return scores.virality(named, ["track_name", "artist_name"]).select("track_name", "artist_name", "platforms", F.round("virality_score", 6).alias("virality_score"), "virality_tier")


@query("songs", """
SELECT rec_id, round((energy * 0.3 + valence * 0.3 + danceability * 0.4) * 100, 6) AS audio_appeal, CAST(coalesce(CASE platform WHEN 'spotify' THEN normalized_popularity > 30 WHEN 'tiktok' THEN normalized_popularity > 5 WHEN 'youtube' THEN normalized_popularity > 10 END, false) AS INT) AS success,
  CASE WHEN normalized_popularity IS NOT NULL THEN round((greatest(0, 80 - normalized_popularity) / 100 * 0.7 + source_count / 3.0 * 0.3) * 100, 6) END AS growth,
  CASE WHEN normalized_popularity IS NOT NULL THEN round(least(greatest((80 - normalized_popularity) * 0.7 + source_count * 10, 0), 100), 6) END AS growth_linear,
  least(greatest(10.0 + CASE WHEN energy > 0.6 THEN 40.0 ELSE 0 END + CASE WHEN danceability > 0.7 THEN 30.0 ELSE 0 END + CASE WHEN tempo BETWEEN 100 AND 140 THEN 25.0 ELSE 0 END, 0), 100)::DOUBLE AS tiktok_label,
  least(greatest(10.0 + CASE WHEN acousticness < 0.5 THEN 30.0 ELSE 0 END + CASE WHEN valence BETWEEN 0.3 AND 0.8 THEN 35.0 ELSE 0 END, 0), 100)::DOUBLE AS spotify_label FROM songs""")
def sc17_sc18_sc23_sc26_sc27_udf4_row_scores(songs):
    eighty = F.lit(80.0)
    popularity, sources = F.col("normalized_popularity"), F.col("source_count")
    labels = scores.rule_labels({"tiktok": [("energy > 0.6", 40), ("danceability > 0.7", 30), ("tempo BETWEEN 100 AND 140", 25)], "spotify": [("acousticness < 0.5", 30), ("valence BETWEEN 0.3 AND 0.8", 35)]}, base=10)
    return songs.select(
        "rec_id", F.round(scores.audio_appeal(), 6).alias("audio_appeal"), scores.popular_enough(popularity, F.col("platform"), {"spotify": 30, "tiktok": 5, "youtube": 10}).alias("success"),
        F.when(popularity.isNotNull(), F.round(scores.growth_potential(eighty, popularity, sources), 6)).alias("growth"), F.round(scores.growth_potential_linear(eighty, popularity, sources), 6).alias("growth_linear"),
        *[c.alias(f"{n}_label") for n, c in labels.items()])


@query("songs", """
WITH g AS (SELECT genre, median(energy) AS e, median(danceability) AS d FROM songs GROUP BY 1), a AS (SELECT median(energy) AS e, median(danceability) AS d FROM songs)
SELECT rec_id, round(coalesce(s.energy, g.e, a.e), 6) AS energy, round(coalesce(s.danceability, g.d, a.d), 6) AS danceability, s.avg_popularity IS NULL AS avg_popularity_missing FROM songs s JOIN g USING (genre), a""")
def imp3_imp7_group_medians(songs):
    flagged = catalog.missing_flags(songs, ["avg_popularity"])
    filled = catalog.fill_by_group(flagged, "genre", ["energy", "danceability"])
    return filled.select("rec_id", F.round("energy", 6).alias("energy"), F.round("danceability", 6).alias("danceability"), "avg_popularity_missing")


@query("songs", """
WITH g AS (SELECT genre, avg(avg_popularity) AS p FROM songs GROUP BY 1)
SELECT rec_id, round(coalesce(avg_popularity, p), 4) AS popularity, coalesce(genre, 'unknown') AS genre FROM songs JOIN g USING (genre)""")
def imp4_imp5_group_means(songs):
    filled = catalog.fill_by_group(songs.select("rec_id", "genre", "avg_popularity"), "genre", ["avg_popularity"], how=F.avg)
    return filled.na.fill({"genre": "unknown"}).select("rec_id", F.round("avg_popularity", 4).alias("popularity"), "genre")


@query("songs", "SELECT rec_id, round(coalesce(energy, (SELECT median(energy) FROM songs)), 6) AS energy, coalesce(genre, (SELECT mode(genre) FROM songs)) AS genre FROM songs")
def imp1_imp2_column_fills(songs):
    return catalog.fill_mode(catalog.fill_median(songs, ["energy"]), ["genre"]).select("rec_id", F.round("energy", 6).alias("energy"), "genre")


@query("stream_users", "WITH m AS (SELECT median(CAST(age AS DOUBLE)) AS mid FROM stream_users WHERE CAST(age AS DOUBLE) BETWEEN 13 AND 100) SELECT user_id, country, CASE WHEN CAST(age AS DOUBLE) BETWEEN 13 AND 100 THEN CAST(age AS DOUBLE) ELSE mid END AS age FROM stream_users, m")
def imp6_valid_ages(stream_users):
    return catalog.replace_invalid(stream_users.withColumn("age", N.to_number(F.col("age"))), "age", 13, 100).select("user_id", "country", "age")


@query("songs", "SELECT rec_id, " + "CASE " + " ".join(f"WHEN contains(lower(genre), '{w}') THEN '{a}/{b}'" for w, (a, b) in catalog.GENRE_AUDIENCES.items()) + " ELSE '18-49/all_ages' END AS audience FROM songs")
def imp8_str13_audiences(songs):
    pair = catalog.audience_defaults(F.col("genre"))
    return songs.select("rec_id", F.concat(pair["primary"], F.lit("/"), pair["secondary"]).alias("audience"))


@query("chart_metrics", """
WITH n AS (SELECT chart_id, CAST(spotify_popularity AS DOUBLE) AS p, coalesce(TRY_CAST(nullif(replace(youtube_views, ',', ''), '') AS DOUBLE), 0) AS v, CAST(youtube_likes AS DOUBLE) AS l FROM chart_metrics),
g AS (SELECT *, log10(CASE WHEN v = 0 THEN 1 ELSE v END) AS lv, log10(CASE WHEN l = 0 THEN 1 ELSE l END) AS ll FROM n),
e AS (SELECT min(lv) v0, max(lv) v1, min(ll) l0, max(ll) l1, min(v) a0, max(v) a1, min(l) b0, max(l) b1 FROM g)
SELECT chart_id, round(least(greatest((p + (lv - v0) / (v1 - v0) * 100 + (ll - l0) / (l1 - l0) * 100) / 3, 0), 100), 6) AS composite,
  round(((v - a0) / (a1 - a0) * 0.5 + (l - b0) / (b1 - b0) * 0.3) / 0.8 * 100, 6) AS engagement FROM g, e""")
def imp9_imp14_num5_popularity_mixes(chart_metrics):
    numbers = chart_metrics.select("chart_id", N.to_number(F.col("spotify_popularity")).alias("p"), F.coalesce(N.messy_number(F.col("youtube_views")), F.lit(0.0)).alias("v"), N.to_number(F.col("youtube_likes")).alias("l"))
    mixed = catalog.engagement_popularity(catalog.composite_popularity(numbers, "p", ["v", "l"]), {"v": 0.5, "l": 0.3})
    return mixed.select("chart_id", F.round("normalized_popularity", 6).alias("composite"), F.round("engagement_popularity", 6).alias("engagement"))


_PLATFORM = """
WITH y AS (SELECT quantile_cont(log10(CASE WHEN avg_popularity = 0 THEN 1 ELSE avg_popularity END), 0.01) AS y1, quantile_cont(log10(CASE WHEN avg_popularity = 0 THEN 1 ELSE avg_popularity END), 0.99) AS y99 FROM songs WHERE youtube),
t AS (SELECT min(avg_popularity) AS t0, max(avg_popularity) AS t1 FROM songs WHERE tiktok),
n AS (SELECT songs.*, CASE WHEN avg_popularity IS NULL THEN NULL WHEN tiktok THEN CASE WHEN t1 <= 100 THEN avg_popularity ELSE (avg_popularity - t0) / (t1 - t0) * 100 END
  WHEN youtube THEN least(greatest((log10(CASE WHEN avg_popularity = 0 THEN 1 ELSE avg_popularity END) - y1) / (y99 - y1) * 100, 0), 100) WHEN spotify THEN least(greatest(avg_popularity, 0), 100) END AS np FROM songs, y, t)
"""


@query("songs", _PLATFORM + ", g AS (SELECT genre, avg(np) AS mean FROM n WHERE genre <> 'unknown' GROUP BY 1) SELECT rec_id, round(least(greatest(coalesce(np, mean, CASE WHEN spotify THEN 45 WHEN youtube THEN 35 WHEN tiktok THEN 55 ELSE 40 END), 0), 100), 6) AS popularity FROM n LEFT JOIN g USING (genre)")
def imp10_imp11_num7_platform_popularity(songs):
    return catalog.fill_popularity(catalog.platform_popularity(songs)).select("rec_id", F.round("normalized_popularity", 6).alias("popularity"))


@query("songs", """
SELECT rec_id, contains(source_dataset, 'spotify') OR NOT (contains(source_dataset, 'tiktok') OR contains(source_dataset, 'youtube')) AS spotify, contains(source_dataset, 'tiktok') AS tiktok,
  CASE WHEN genre <> 'unknown' THEN genre WHEN danceability IS NULL OR energy IS NULL THEN 'unknown' WHEN danceability > 0.7 AND energy > 0.7 AND acousticness < 0.3 THEN 'electronic'
    WHEN danceability > 0.6 AND energy > 0.5 AND valence > 0.5 THEN 'pop' WHEN acousticness > 0.7 AND energy < 0.5 THEN 'acoustic' WHEN energy > 0.6 AND acousticness < 0.2 AND danceability > 0.6 THEN 'hip hop'
    WHEN instrumentalness > 0.7 THEN 'classical' ELSE 'pop' END AS genre FROM songs""")
def imp12_imp13_repairs(songs):
    return catalog.repair_platforms(songs, "source_dataset").select("rec_id", "spotify", "tiktok", catalog.infer_genre().alias("genre"))


@query("songs", "SELECT platform, count(*) AS n, count(avg_popularity) AS known, min(avg_popularity) AS least, max(avg_popularity) AS most, round(avg(avg_popularity), 4) AS mean, count(*) FILTER (WHERE avg_popularity > 100) AS beyond FROM songs GROUP BY 1")
def imp15_popularity_issues(songs):
    p = F.col("avg_popularity")
    return songs.groupBy("platform").agg(F.count("*").alias("n"), F.count(p).alias("known"), F.min(p).alias("least"), F.max(p).alias("most"), F.round(F.avg(p), 4).alias("mean"), F.count_if(p > 100).alias("beyond"))


@query("songs", """
SELECT rec_id, 'spotify' AS platform, normalized_popularity FROM songs WHERE spotify UNION ALL SELECT rec_id, 'tiktok', normalized_popularity FROM songs WHERE tiktok UNION ALL SELECT rec_id, 'youtube', normalized_popularity FROM songs WHERE youtube""")
def ds2_platform_performance(songs):
    rows = F.array(*[F.struct(F.lit(p).alias("platform"), F.col(p).alias("on")) for p in scores.PLATFORMS])
    return songs.select("rec_id", "normalized_popularity", F.explode(F.filter(rows, lambda x: x["on"])).alias("r")).select("rec_id", F.col("r.platform").alias("platform"), "normalized_popularity")


@query("songs", " UNION ALL ".join(f"SELECT rec_id, '{n}' AS demographic, {_fit(p)} AS match_score FROM songs WHERE {_fit(p)} > 60" for n, p in scores.AGE_PROFILES.items()))
def ds3_jn11_sc19_sc20_demographic_matches(songs):
    rows = F.array(*[F.struct(F.lit(n).alias("demographic"), scores.profile_fit(p, digits=4).alias("match_score")) for n, p in scores.AGE_PROFILES.items()])
    return songs.select("rec_id", F.inline(rows)).where("match_score > 60")


@query("songs", """
SELECT 'genre' AS category, genre AS item, count(*) AS track_count, round(avg(energy), 6) AS energy, round(avg(normalized_popularity), 4) AS popularity FROM songs GROUP BY genre HAVING count(*) >= 5
UNION ALL SELECT 'platform', platform, count(*), round(avg(energy), 6), round(avg(normalized_popularity), 4) FROM songs GROUP BY platform""")
def ds4_agg3_trend_analysis(songs):
    measures = [F.count("*").alias("track_count"), F.round(F.avg("energy"), 6).alias("energy"), F.round(F.avg("normalized_popularity"), 4).alias("popularity")]
    genres = songs.groupBy(F.lit("genre").alias("category"), F.col("genre").alias("item")).agg(*measures).where("track_count >= 5")
    return genres.unionByName(songs.groupBy(F.lit("platform").alias("category"), F.col("platform").alias("item")).agg(*measures))


@query("songs", f"""
SELECT rec_id, track_name, artist_name, genre, round(coalesce(energy, (SELECT median(energy) FROM songs)), 6) AS energy, round(coalesce(danceability, (SELECT median(danceability) FROM songs)), 6) AS danceability,
  CASE WHEN normalized_popularity IS NULL THEN 'unknown' WHEN normalized_popularity >= 80 THEN 'viral' WHEN normalized_popularity >= 60 THEN 'popular' WHEN normalized_popularity >= 40 THEN 'moderate' WHEN normalized_popularity >= 20 THEN 'niche' ELSE 'underground' END AS popularity_tier,
  {_QUALITY} AS data_quality_score FROM songs""")
def ds1_num4_master_music_data(songs):
    scored = songs.withColumn("data_quality_score", scores.data_quality())
    tier = N.tiers(F.col("normalized_popularity"), [(80, "viral"), (60, "popular"), (40, "moderate"), (20, "niche")], "underground")
    return catalog.fill_median(scored, ["energy", "danceability"]).select(
        "rec_id", "track_name", "artist_name", "genre", F.round("energy", 6).alias("energy"), F.round("danceability", 6).alias("danceability"), tier.alias("popularity_tier"), "data_quality_score")


_KEYED = "SELECT *, artist_name || '||' || track_name AS k FROM tracks"


@query("tracks", f"""
SELECT k, arg_min(rec_id, (source_priority, source_dataset, rec_id)) AS base, count(*) AS record_count, count(DISTINCT source_dataset) AS source_count, list_sort(list(DISTINCT source_dataset)) AS all_sources,
  round(median(energy), 6) AS energy, round(avg(popularity_score), 4) AS avg_popularity, max(popularity_score) AS max_popularity, coalesce(mode(CASE WHEN genre <> 'unknown' THEN genre END), 'unknown') AS genre,
  bool_or(contains(source_dataset, 'spotify')) AS spotify FROM ({_KEYED}) GROUP BY k""")
def er9_er1_survivorship(tracks):
    keyed = tracks.withColumn("k", F.concat("artist_name", F.lit("||"), "track_name"))
    merged = catalog.merge_groups(keyed, "k", ["energy"], base=("rec_id",))
    return merged.select("k", F.col("rec_id").alias("base"), "record_count", "source_count", "all_sources", F.round("energy", 6).alias("energy"), F.round("avg_popularity", 4).alias("avg_popularity"), "max_popularity", "genre", "spotify")


@query("tracks", f"SELECT sha256(k) AS master_id, count(*) AS n, min(rec_id) AS first_record FROM ({_KEYED}) GROUP BY 1")
def er10_jn14_id_mapping(tracks):
    keyed = tracks.withColumn("k", F.concat("artist_name", F.lit("||"), "track_name"))
    mapping = catalog.id_mapping(keyed, "k").select(F.unhex("master_id").alias("id"), F.explode("records.record").alias("rec_id"))
    back = mapping.join(tracks.select("rec_id").distinct(), "rec_id").groupBy("id").agg(F.count("*").alias("n"), F.min("rec_id").alias("first_record"))
    return back.select(F.lower(F.hex("id")).alias("master_id"), "n", "first_record")


@query("songs", """
SELECT track_name, artist_name, count(*) AS merged, round(median(energy), 6) AS energy, max(normalized_popularity) AS popularity, bool_or(tiktok) AS tiktok FROM songs GROUP BY ALL""")
def er11_exact_duplicates(songs):
    merged = catalog.merge_duplicates(songs, ["track_name", "artist_name"], ["energy", "danceability", "valence", "acousticness", "instrumentalness"])
    return merged.select("track_name", "artist_name", "merged", F.round("energy", 6).alias("energy"), F.col("normalized_popularity").alias("popularity"), "tiktok")


@query("songs", """
WITH g AS (SELECT track_name, artist_name, count(*) AS n, max(source_count) AS s FROM songs GROUP BY ALL)
SELECT count(*) FILTER (WHERE n > 1) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS removed, CAST(sum(n) AS BIGINT) AS original, count(*) AS final, round(coalesce(sum(n - 1), 0) * 100.0 / sum(n), 6) AS percent, count(*) FILTER (WHERE s > 1) AS multi_source FROM g""")
def er13_er14_duplicate_audit(songs):
    groups = songs.groupBy("track_name", "artist_name").agg(F.count("*").alias("n"), F.max("source_count").alias("s"))
    return groups.agg(
        F.count_if(F.col("n") > 1).alias("groups"), F.sum(F.col("n") - 1).alias("removed"), F.sum("n").alias("original"), F.count("*").alias("final"),
        F.round(F.sum(F.col("n") - 1) * 100 / F.sum("n"), 6).alias("percent"), F.count_if(F.col("s") > 1).alias("multi_source"))


@query("tracks", "SELECT source_dataset, min(source_priority) AS priority, count(*) AS rows, round((count(energy) + count(danceability)) * 50.0 / count(*), 6) AS completeness FROM tracks GROUP BY 1")
def val19_source_contribution(tracks):
    return tracks.groupBy("source_dataset").agg(F.min("source_priority").alias("priority"), F.count("*").alias("rows"), F.round((F.count("energy") + F.count("danceability")) * 50 / F.count("*"), 6).alias("completeness"))


_MEASURED = ["danceability", "energy", "valence", "acousticness", "instrumentalness", "liveness", "speechiness", "tempo", "loudness"]


def flagship(tracks, least=None):
    """Resolved, repaired, normalised and scored master catalog; ``least`` also merges composite keys at that ratio.

    The tracks are written once with their keys, and so are the masters of several tracks; global and genre figures read these.
    """
    keyed = tracks.withColumn("k", T.composite_key(F.col("artist_name"), F.col("track_name")))
    if least is not None:
        keyed = matching.resolve(keyed, "k", least)
    # cleaning the names costs more than all that follows
    keyed = tables.settled(keyed.select("k", "rec_id", "source_dataset", "source_priority", "track_name", "artist_name", "genre", "popularity_score", *_MEASURED))
    masters = catalog.merge_few_groups(keyed, "k", _MEASURED)
    normalized = catalog.platform_popularity(catalog.repair_platforms(masters))
    named = catalog.with_master_id(normalized, "k")  # hashes don't pack, so they aren't written
    return scores.with_ar_scores(catalog.fill_popularity(named).withColumn("genre", catalog.infer_genre()))


@query("tracks")
def ds13_er5_fuzzy_integration(tracks):
    """The integration job over names without their numbers, with composite keys grouped at a ratio of 85."""
    plain = lambda c: F.trim(F.regexp_replace(c, "[#0-9]+", ""))
    named = tracks.withColumns({"track_name": plain("track_name"), "artist_name": plain("artist_name")})
    return flagship(named, least=85).select("master_id", "track_name", "artist_name", "genre", "record_count", "source_count", "all_sources")


@query("tracks")
def ds13_integration_job(tracks):
    scored = flagship(tracks)
    return scored.select("master_id", "track_name", "artist_name", "genre", "source_count", "all_sources", "normalized_popularity", "data_quality_score", "ar_score")


@query("songs", "SELECT genre, count(*) FILTER (WHERE size1 > 1) AS mixed FROM (SELECT artist_name, count(DISTINCT genre) AS size1, min(genre) AS genre FROM songs GROUP BY 1) GROUP BY 1")
def val9_genre_consistency(songs):
    sets = songs.groupBy("artist_name").agg(F.array_distinct(F.collect_set("genre")).alias("genres"))
    return sets.groupBy(F.array_min("genres").alias("genre")).agg(F.count_if(F.size("genres") > 1).alias("mixed"))


@query("songs", """
WITH c AS (SELECT count(*) AS n, (count(energy) + count(danceability) + count(genre)) / (3.0 * count(*)) * 100 AS completeness, count(DISTINCT source_dataset) AS sources, count(*) FILTER (WHERE avg_popularity IS NULL) AS gaps FROM songs)
SELECT round(completeness, 6) AS completeness, round(0.7 * completeness + 0.3 * least(10 * sources, 30), 6) AS overall, CASE WHEN 0.7 * completeness + 0.3 * least(10 * sources, 30) >= 75 THEN 'good' ELSE 'poor' END AS category FROM c""")
def val15_quality_summary(songs):
    complete = (F.count("energy") + F.count("danceability") + F.count("genre")) / (F.count("*") * 3) * 100
    row = songs.agg(complete.alias("completeness"), F.countDistinct("source_dataset").alias("sources"))
    overall = F.col("completeness") * 0.7 + F.least(F.col("sources") * 10, F.lit(30)) * 0.3
    return row.select(F.round("completeness", 6).alias("completeness"), F.round(overall, 6).alias("overall"), F.when(overall >= 75, "good").otherwise("poor").alias("category"))


@query("songs", """
SELECT count(*) AS n, round(var_samp(avg_popularity) FILTER (WHERE source_count > 1), 2) AS variance, count(*) FILTER (WHERE avg_popularity - normalized_popularity > 30) AS apart FROM songs WHERE avg_popularity IS NOT NULL""")
def val8_popularity_consistency(songs):
    return songs.where("avg_popularity IS NOT NULL").agg(F.count("*").alias("n"), F.round(F.var_samp(F.when(F.col("source_count") > 1, F.col("avg_popularity"))), 2).alias("variance"), F.count_if(F.col("avg_popularity") - F.col("normalized_popularity") > 30).alias("apart"))


@query("songs", f"""
WITH m AS (SELECT genre, avg(danceability) AS danceability, avg(energy) AS energy, avg(valence) AS valence, avg(tempo) AS tempo, avg(speechiness) AS speechiness, avg(acousticness) AS acousticness FROM songs GROUP BY 1),
f AS ({' UNION ALL '.join(f"SELECT genre, '{n}' AS demographic, {_fit(p)} AS fit FROM m" for n, p in scores.AGE_PROFILES.items())})
SELECT genre, arg_max(demographic, fit) AS best, round(max(fit), 2) AS fit FROM f GROUP BY 1""")
def val10_val11_genre_audience_fit(songs):
    means = stats_means(songs)
    rows = F.array(*[F.struct(scores.profile_fit(p, digits=4).alias("fit"), F.lit(n).alias("demographic")) for n, p in scores.AGE_PROFILES.items()])
    return means.select("genre", F.array_max(rows).alias("b")).select("genre", F.col("b.demographic").alias("best"), F.round("b.fit", 2).alias("fit"))


def stats_means(songs):
    return songs.groupBy("genre").agg(*[F.avg(c).alias(c) for c in ("danceability", "energy", "valence", "tempo", "speechiness", "acousticness")])


@query("songs", """
WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE energy BETWEEN 0.5 AND 1 AND danceability BETWEEN 0.6 AND 1 AND valence BETWEEN 0.4 AND 1) AS inside FROM songs)
SELECT round(inside * 100.0 / n, 6) AS share FROM t""")
def val12_match_share(songs):
    inside = F.col("energy").between(0.5, 1) & F.col("danceability").between(0.6, 1) & F.col("valence").between(0.4, 1)
    return songs.agg(F.round(F.count_if(inside) * 100 / F.count("*"), 6).alias("share"))


@query("songs", """
WITH g AS (SELECT genre, count(*) * 100.0 / (SELECT count(*) FROM songs) AS p FROM songs GROUP BY 1)
SELECT round(greatest(0, 100 - 2 * stddev_pop(p)), 6) AS balance, round(count(*) FILTER (WHERE p >= 1) * 100.0 / count(*), 6) AS coverage FROM g""")
def val13_coverage_balance(songs):
    shares = stats.share_of_total(songs, "genre")
    return shares.agg(F.round(F.greatest(F.lit(0.0), 100 - 2 * F.stddev_pop("share")), 6).alias("balance"), F.round(F.count_if(F.col("share") >= 1) * 100 / F.count("*"), 6).alias("coverage"))


@query("songs", """
WITH m AS (SELECT unnest(['completeness', 'sources']) AS metric, unnest([count(energy) * 100.0 / count(*), count(DISTINCT source_dataset)]::DOUBLE[]) AS value FROM songs)
SELECT metric, CASE metric WHEN 'completeness' THEN 'high' ELSE 'low' END AS priority FROM m WHERE (metric = 'completeness' AND value < 99) OR (metric = 'sources' AND value < 3)""")
def val20_val26_recommendation_rules(songs):
    row = songs.agg((F.count("energy") * 100 / F.count("*")).alias("completeness"), F.countDistinct("source_dataset").cast("double").alias("sources"))
    metrics = row.unpivot([], ["completeness", "sources"], "metric", "value")
    rules = songs.sparkSession.createDataFrame([("completeness", 99.0, "high"), ("sources", 3.0, "low")], "metric string, below double, priority string")
    return metrics.join(F.broadcast(rules), "metric").where("value < below").select("metric", "priority")


#: how each source names what all tables must have
_SOURCES = {s: {"track_clean": ["track_name"], "artist_clean": ["artist_name"], "popularity_score": ["popularity_score"], "energy": ["energy"], "rec_id": ["rec_id"]} for s in ("music_info", "spotify_main", "spotify_secondary", "youtube", "tiktok_2021", "tiktok_2022")}


@query("tracks", """
SELECT source_dataset, rec_id, track_name AS track_clean, artist_name AS artist_clean, coalesce(popularity_score, (SELECT median(popularity_score) FROM tracks)) AS popularity_score, round(coalesce(energy, (SELECT median(energy) FROM tracks)), 9) AS energy,
  CASE WHEN contains(source_dataset, 'tiktok') THEN 'tiktok' WHEN contains(source_dataset, 'youtube') THEN 'youtube' WHEN contains(source_dataset, 'spotify') THEN 'spotify' ELSE 'catalog' END AS platform FROM tracks""")
def ds8_ds10_unified_table(tracks):
    parts = []
    for source, names in _SOURCES.items():
        own = tables.standardize(tracks.where(F.col("source_dataset") == source), names, keep=["source_dataset"])
        parts.append(own.withColumn("platform", F.lit(next((p for p in scores.PLATFORMS if p in source), "catalog"))))
    return catalog.fill_median(tables.union_all(*parts), ["popularity_score", "energy"]).withColumn("energy", F.round("energy", 9))


@query("songs", f"SELECT rec_id, track_name, {_QUALITY} AS data_quality_score FROM songs")
def top8_sort_by_quality(songs):
    return songs.select("rec_id", "track_name", scores.data_quality().alias("data_quality_score")).orderBy(F.desc("data_quality_score"), "rec_id")
