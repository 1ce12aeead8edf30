"""Queries over training tables, cleaning jobs, group-against-profile rankings and platform texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from resona.functions import numeric as N
from resona.functions import text as T
from resona.operators import catalog, insights, models, scores, stats, tables
from resona.plans.query import query
from resona.plans.scoring import _fit

_AGES = scores.AGE_PROFILES
_GROUP_MEANS = "m AS (SELECT genre, " + ", ".join(f"avg({c}) AS {c}" for c in ("danceability", "energy", "valence", "tempo", "speechiness", "acousticness")) + " FROM songs GROUP BY 1)"


def _group_means(songs):
    return songs.groupBy("genre").agg(*[F.avg(c).alias(c) for c in ("danceability", "energy", "valence", "tempo", "speechiness", "acousticness")])


@query("stream_users", """
WITH c AS (SELECT trim(user_id) AS user_id, CASE WHEN CAST(age AS DOUBLE) BETWEEN 13 AND 100 THEN CAST(age AS DOUBLE) END AS age, lower(trim(platform)) AS platform, trim(country) AS country,
  TRY_CAST(nullif(minutes_per_day, 'n/a') AS DOUBLE) AS minutes, least(greatest(CAST(replace(engagement_pct, '%', '') AS DOUBLE), 0), 100) AS engagement FROM stream_users WHERE trim(user_id) <> ''),
f AS (SELECT user_id, coalesce(age, (SELECT median(age) FROM c)) AS age, platform, country, coalesce(minutes, (SELECT median(minutes) FROM c)) AS minutes, engagement FROM c)
SELECT user_id, age, platform, country, minutes, engagement FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY age, country, platform, minutes, engagement) AS n FROM f) WHERE n = 1""")
def ds14_user_cleaning_job(stream_users):
    def named(df):
        return df.where(tables.not_blank("user_id")).withColumns({c: F.trim(c) for c in ("user_id", "country", "platform")}).withColumn("platform", F.lower("platform"))

    def typed(df):
        return df.withColumns({"age": N.within(N.to_number(F.col("age")), 13, 100), "minutes": N.messy_number(F.col("minutes_per_day")), "engagement": N.clip(N.percent_number(F.col("engagement_pct")), 0, 100)})

    def filled(df):
        return catalog.fill_median(df, ["age", "minutes"])

    def unique(df):
        columns = ["user_id", "age", "platform", "country", "minutes", "engagement"]
        return tables.first_per_key(df.select(columns), ["user_id"], ["age", "country", "platform", "minutes", "engagement"])

    return stream_users.transform(named).transform(typed).transform(filled).transform(unique)


@query("stream_users", "SELECT count(*) AS before, count(*) FILTER (WHERE trim(user_id) = '') AS blank_ids, count(*) FILTER (WHERE NOT CAST(age AS DOUBLE) BETWEEN 13 AND 100) AS bad_ages, count(*) FILTER (WHERE minutes_per_day = 'n/a') AS no_minutes FROM stream_users")
def val23_cleaning_counters(stream_users):
    age = N.to_number(F.col("age"))
    return stream_users.agg(
        F.count("*").alias("before"), F.count_if(F.trim("user_id") == "").alias("blank_ids"), F.count_if(~age.between(13, 100)).alias("bad_ages"), F.count_if(F.col("minutes_per_day") == "n/a").alias("no_minutes"))


_TIES = "SELECT artist_name, arg_min(v, (-n, v)) AS v FROM (SELECT artist_name, {0} AS v, count(*) AS n FROM songs GROUP BY ALL) GROUP BY 1"


@query("songs", f"""
WITH a AS ({_TIES.format("coalesce(nullif(regexp_extract(source_dataset, '([0-9]+)', 1), ''), 'unknown')")}), p AS ({_TIES.format('platform')}),
s AS (SELECT artist_name, round(avg(normalized_popularity), 4) AS score FROM songs GROUP BY 1)
SELECT artist_name, a.v AS period, p.v AS platform, score FROM a JOIN p USING (artist_name) JOIN s USING (artist_name)""")
def ds5_demographic_training_table(songs):
    period = T.extract_or(F.col("source_dataset"), r"([0-9]+)", "unknown")
    summary = songs.withColumn("period", period).groupBy("artist_name").agg(stats.mode_of("period").alias("period"), stats.mode_of("platform").alias("platform"))
    measured = songs.groupBy("artist_name").agg(F.round(F.avg("normalized_popularity"), 4).alias("score"))
    return summary.join(measured, "artist_name")


@query("songs", """
WITH p AS (SELECT artist_name, coalesce(avg(normalized_popularity) FILTER (WHERE platform = 'spotify'), 0) AS spotify, coalesce(avg(normalized_popularity) FILTER (WHERE platform = 'tiktok'), 0) AS tiktok FROM songs GROUP BY 1),
f AS (SELECT artist_name, avg(energy) AS energy FROM songs GROUP BY 1)
SELECT artist_name, round(energy, 6) AS energy, round(spotify, 4) AS spotify, round(tiktok, 4) AS tiktok FROM p JOIN f USING (artist_name) WHERE spotify + tiktok > 0""")
def ds6_platform_training_table(songs):
    plain = songs.select("artist_name", "platform", "normalized_popularity")
    scored = stats.pivot_mean(plain, ["artist_name"], "platform", ["spotify", "tiktok"], "normalized_popularity")
    features = songs.groupBy("artist_name").agg(F.round(F.avg("energy"), 6).alias("energy"))
    return features.join(scored, "artist_name").where(F.col("spotify") + F.col("tiktok") > 0).select("artist_name", "energy", F.round("spotify", 4).alias("spotify"), F.round("tiktok", 4).alias("tiktok"))


@query("songs", """
WITH v AS (SELECT track_name, artist_name, max(normalized_popularity) AS peak, count(DISTINCT platform) AS platforms FROM songs GROUP BY ALL),
a AS (SELECT artist_name, count(DISTINCT platform) AS artist_platforms FROM songs GROUP BY 1)
SELECT rec_id, peak, platforms > 1 AS is_cross_platform, artist_platforms, artist_platforms > 1 AS artist_is_cross_platform, CASE WHEN tempo > 0 AND tempo <= 100 THEN 'slow' WHEN tempo > 100 AND tempo <= 300 THEN 'fast' END AS pace FROM songs JOIN v USING (track_name, artist_name) JOIN a USING (artist_name)""")
def ds9_comprehensive_features(songs):
    v = songs.groupBy("track_name", "artist_name").agg(F.max("normalized_popularity").alias("peak"), F.countDistinct("platform").alias("platforms"))
    per_artist = songs.groupBy("artist_name").agg(F.countDistinct("platform").alias("artist_platforms"))
    joined = tables.enrich(tables.enrich(songs, v, ["track_name", "artist_name"]), per_artist, ["artist_name"])
    return joined.select("rec_id", "peak", (F.col("platforms") > 1).alias("is_cross_platform"), "artist_platforms", (F.col("artist_platforms") > 1).alias("artist_is_cross_platform"), N.cut_bins(F.col("tempo"), [0, 100, 300], ["slow", "fast"]).alias("pace"))


@query("songs", f"""
WITH {_GROUP_MEANS}, f AS ({' UNION ALL '.join(f"SELECT genre, '{n}' AS audience, {_fit(p)} AS fit FROM m" for n, p in _AGES.items())})
SELECT genre, audience, round(fit, 2) AS fit, CAST(row_number() OVER (PARTITION BY genre ORDER BY fit DESC, audience) AS INT) AS rank FROM f""")
def ml9_ml12_ins12_group_audience_ranking(songs):
    rows = F.array(*[F.struct(F.lit(n).alias("audience"), scores.profile_fit(p, digits=4).alias("fit")) for n, p in _AGES.items()])
    long = _group_means(songs).select("genre", F.inline(rows))
    return tables.top_per_group(long, ["genre"], [F.desc("fit"), F.col("audience")], len(_AGES)).withColumn("fit", F.round("fit", 2))


@query("songs", """
WITH c AS (SELECT platform, genre, count(*) AS n FROM songs GROUP BY ALL)
SELECT platform, genre, round(n * 100.0 / sum(n) OVER (PARTITION BY platform), 6) AS share, n = max(n) OVER (PARTITION BY platform) AS is_largest FROM c""")
def ml10_ml11_platform_distribution(songs):
    counts = songs.groupBy("platform", "genre").agg(F.count("*").alias("n"))
    totals = counts.groupBy("platform").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    return counts.join(totals, "platform").select("platform", "genre", F.round(F.col("n") * 100 / F.col("all"), 6).alias("share"), (F.col("n") == F.col("most")).alias("is_largest"))


@query("songs", """
WITH m AS (SELECT genre, avg(energy) AS energy, avg(danceability) AS danceability, avg(valence) AS valence, avg(acousticness) AS acousticness, count(*) AS size FROM songs GROUP BY 1)
SELECT genre, size, round(size * 100.0 / (SELECT sum(size) FROM m), 6) AS share, list_filter([CASE WHEN energy > 0.6 THEN 'high energy' WHEN energy < 0.4 THEN 'calm' END, CASE WHEN danceability > 0.6 THEN 'danceable' WHEN danceability < 0.4 THEN 'listening' END,
  CASE WHEN valence > 0.6 THEN 'upbeat' WHEN valence < 0.4 THEN 'moody' END, CASE WHEN acousticness > 0.6 THEN 'acoustic' WHEN acousticness < 0.4 THEN 'electronic' END], lambda x: x IS NOT NULL) AS labels FROM m""")
def ml8_group_profiles(songs):
    labelled = songs.withColumnRenamed("genre", "cluster")
    found = models.sound_profiles(labelled, ["energy", "danceability", "valence", "acousticness"])
    return found.select(F.col("cluster").alias("genre"), "size", F.round("share", 6).alias("share"), "labels")


@query("songs", f"""
WITH {_GROUP_MEANS}, g AS (SELECT genre, list_sort([{', '.join(f"{{'m': -({_fit(p)}), 'a': '{n}'}}" for n, p in _AGES.items())}])[1:2] AS best FROM m),
s AS (SELECT rec_id, genre, list_sort([{', '.join(f"{{'m': -({_fit(p)}), 'a': '{n}'}}" for n, p in _AGES.items())}])[1].a AS own FROM songs)
SELECT rec_id, CASE WHEN list_contains(list_transform(best, lambda x: x.a), own) THEN 85 ELSE 65 END AS confidence FROM s JOIN g USING (genre)""")
def ml14_agreement_confidence(songs):
    best = F.array_sort(F.array(*[F.struct((-scores.profile_fit(p, digits=4)).alias("m"), F.lit(n).alias("a")) for n, p in _AGES.items()]))
    groups = _group_means(songs).select("genre", F.transform(F.slice(best, 1, 2), lambda x: x["a"]).alias("liked"))
    own = songs.select("rec_id", "genre", best[0]["a"].alias("own"))
    return own.join(groups, "genre").select("rec_id", F.when(F.array_contains("liked", F.col("own")), 85).otherwise(65).alias("confidence"))


_CHANCE = {
    "tiktok": "least(100, coalesce(danceability, 0.5) * 40 + coalesce(energy, 0.5) * 35 + coalesce(valence, 0.5) * 25) / 100",
    "spotify": "least(100, coalesce(valence, 0.5) * 30 + coalesce(energy, 0.5) * 25 + coalesce((energy * 0.3 + valence * 0.3 + danceability * 0.4) * 100, 50) * 0.45) / 100",
    "youtube": "least(100, coalesce(energy, 0.5) * 35 + coalesce(valence, 0.5) * 30 + (1 - coalesce(instrumentalness, 0.5)) * 35) / 100",
}


def _said(platform: str) -> str:
    rules, last = insights.PLATFORM_TEXTS[platform]
    return "CASE " + " ".join(f"WHEN {_CHANCE[platform]} > {p}{f' AND {f} > {x}' if f else ''} THEN '{t}'" for f, x, p, t in rules) + f" ELSE '{last}' END"


@query("songs", f"SELECT rec_id, {', '.join(f'{_said(p)} AS {p}' for p in _CHANCE)} FROM songs")
def ins4_platform_texts(songs):
    chance = insights.fallback_platforms()
    return songs.withColumn("audio_appeal", scores.audio_appeal()).select("rec_id", *[insights.platform_text(p, chance[p] / 100).alias(p) for p in _CHANCE])


@query("songs", """
WITH m AS (SELECT genre, avg(energy) AS energy, avg(danceability) AS danceability, avg(acousticness) AS acousticness, count(*) AS size FROM songs GROUP BY 1),
p AS (SELECT genre, platform, round(count(*) * 100.0 / any_value(size), 6) AS percentage FROM songs JOIN m USING (genre) GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY percentage DESC, platform) AS place FROM p),
l AS (SELECT genre, list(platform ORDER BY place) AS platforms, list(CASE WHEN percentage > 30 THEN 'High' ELSE 'Medium' END ORDER BY place) AS priorities, list(percentage ORDER BY place)[1] AS largest FROM t WHERE place <= 3 GROUP BY 1)
SELECT genre, CASE WHEN danceability > 0.6 AND energy > 0.6 THEN ['Gen Z (16-24)', 'Millennials (25-40)'] WHEN acousticness > 0.6 THEN ['Gen X (41-56)', 'Boomers (57+)'] ELSE [] END AS audiences,
  CASE WHEN danceability > 0.6 AND energy > 0.6 THEN ['Focus on dance challenges and high-energy content'] WHEN acousticness > 0.6 THEN ['Emphasize intimate, authentic performances'] ELSE [] END AS content, platforms, priorities, largest FROM m JOIN l USING (genre)""")
def ml13_group_strategies(songs):
    profiles = models.sound_profiles(songs.withColumnRenamed("genre", "cluster"), ["energy", "danceability", "valence", "acousticness"]).withColumnRenamed("cluster", "genre")
    sizes = profiles.select("genre", "size")
    shares = songs.groupBy("genre", "platform").agg(F.count("*").alias("n")).join(sizes, "genre").select("genre", "platform", F.round(F.col("n") * 100 / F.col("size"), 6).alias("percentage"))
    listed = lambda name: F.transform("platforms", lambda x: x[name])
    found = insights.group_strategies(profiles, shares, "genre")
    return found.select("genre", "audiences", "content", listed("platform").alias("platforms"), listed("priority").alias("priorities"), F.col("platforms")[0]["percentage"].alias("largest"))


@query("songs", """
SELECT rec_id, round(energy * 0.4 + danceability * 0.4 + valence * 0.2, 6) AS gen_z, round(acousticness * 0.3 + energy * 0.3 + valence * 0.2 + (1 - instrumentalness) * 0.2, 6) AS millennials,
  round((1 - abs(energy - 0.5) * 2 + 1 - abs(danceability - 0.5) * 2 + 1 - abs(valence - 0.5) * 2 + 1 - abs(acousticness - 0.5) * 2) / 4, 6) AS cross_platform FROM songs""")
def sc5_linear_alignment(songs):
    return songs.select("rec_id", *[F.round(c, 6).alias(n) for n, c in scores.linear_alignment().items()])


@query("songs", """
WITH v AS (SELECT rec_id, (coalesce(energy, 0) + coalesce(danceability, 0) + valence) / (1 + CAST(energy IS NOT NULL AS INT) + CAST(danceability IS NOT NULL AS INT)) AS s FROM songs), e AS (SELECT min(s) AS lo, max(s) AS hi FROM v)
SELECT rec_id, round((s - lo) / (hi - lo), 6) AS virality_score FROM v, e""")
def sc7_fallback_virality(songs):
    return scores.with_fallback_virality(songs).select("rec_id", F.round("virality_score", 6).alias("virality_score"))


@query("songs")
def ds15_ml20_ml24_training_job(songs):
    """Feature selection, one forest per audience target, and the importances of each."""
    features = ["danceability", "energy", "valence", "acousticness", "instrumentalness", "liveness", "speechiness", "tempo"]
    ready = tables.settled(songs.where("danceability IS NOT NULL AND energy IS NOT NULL").select(*features, "normalized_popularity", "genre", "platform"))
    chosen = models.select_features(ready.where("normalized_popularity IS NOT NULL"), features, "normalized_popularity", k=6)
    trained = models.audience_models(ready, chosen, ["genre", "platform"], trees=10, depth=5)
    parts = [models.importances(model, chosen, songs.sparkSession).withColumn("target", F.lit(name)) for name, (model, _) in trained.items()]
    return tables.union_all(*parts)
