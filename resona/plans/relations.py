"""Queries over joins, aggregates, windows, rankings, set operations and profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from resona.operators import quantiles, stats, tables
from resona.plans.query import query

FEATURES = ["danceability", "energy", "valence", "acousticness", "speechiness"]
_LONG = " UNION ALL ".join(f"SELECT platform, genre, rec_id, avg_popularity, '{f}' AS feature, {f} AS value FROM songs" for f in FEATURES)


@query("songs", """
SELECT p.artist_name, p.genre, round(p.energy, 6) AS energy, round(q.valence, 6) AS valence FROM
  (SELECT artist_name, genre, avg(energy) AS energy FROM songs WHERE spotify GROUP BY ALL) p JOIN (SELECT artist_name, genre, avg(valence) AS valence FROM songs WHERE tiktok GROUP BY ALL) q
  ON p.artist_name = q.artist_name AND p.genre = q.genre""")
def jn1_two_key_join(songs):
    left = songs.where("spotify").groupBy("artist_name", "genre").agg(F.round(F.avg("energy"), 6).alias("energy"))
    right = songs.where("tiktok").groupBy("artist_name", "genre").agg(F.round(F.avg("valence"), 6).alias("valence"))
    return left.join(right, ["artist_name", "genre"])


@query("songs", """
SELECT l.artist_name, round(coalesce(r.energy, l.energy), 6) AS energy, l.n FROM (SELECT artist_name, avg(energy) AS energy, count(*) AS n FROM songs GROUP BY 1) l
JOIN (SELECT artist_name, avg(energy) AS energy FROM songs WHERE genre = 'pop' GROUP BY 1) r USING (artist_name)""")
def jn2_prefer_right(songs):
    left = songs.groupBy("artist_name").agg(F.avg("energy").alias("energy"), F.count("*").alias("n"))
    right = songs.where("genre = 'pop'").groupBy("artist_name").agg(F.avg("energy").alias("energy"))
    return tables.join_preferring_right(left, right, ["artist_name"], ["energy"]).withColumn("energy", F.round("energy", 6)).select("artist_name", "energy", "n")


@query("songs", """
WITH v AS (SELECT artist_name, max(avg_popularity) AS peak FROM songs WHERE tiktok GROUP BY 1), j AS (SELECT rec_id, peak FROM songs LEFT JOIN v USING (artist_name))
SELECT rec_id, round(coalesce(peak, (SELECT avg(peak) FROM j)), 6) AS peak FROM j""")
def jn3_jn4_left_enrich(songs):
    peaks = songs.where("tiktok").groupBy("artist_name").agg(F.max("avg_popularity").alias("peak"))
    return tables.enrich(songs, peaks, ["artist_name"], fill_mean="peak").select("rec_id", F.round("peak", 6).alias("peak"))


@query("songs", """
WITH a AS (SELECT artist_name, avg(energy) AS m FROM songs GROUP BY 1)
SELECT rec_id FROM songs WHERE artist_name IN (SELECT artist_name FROM a WHERE m >= (SELECT quantile_cont(m, 0.8) FROM a))""")
def jn5_jn6_top_quintile_members(songs):
    means = songs.groupBy("artist_name").agg(F.avg("energy").alias("m"))
    cut = quantiles.quantile_row(means, ["m"], (0.8,)).select(F.col("m")[0].alias("q"))
    top = means.crossJoin(F.broadcast(cut)).where("m >= q").select("artist_name")
    return songs.join(top, "artist_name", "left_semi").select("rec_id")


@query("songs", "SELECT rec_id FROM songs s WHERE NOT EXISTS (SELECT 1 FROM songs t WHERE t.track_name = s.track_name AND t.artist_name = s.artist_name AND t.rec_id <> s.rec_id)")
def jn7_singletons(songs):
    many = songs.groupBy("track_name", "artist_name").agg(F.count("*").alias("n")).where("n > 1")
    return songs.join(many, ["track_name", "artist_name"], "left_anti").select("rec_id")


@query("songs", """
SELECT rec_id, CAST(CASE genre WHEN 'pop' THEN 0.9 WHEN 'rock' THEN 0.6 ELSE 0.5 END AS DOUBLE) AS affinity, count(*) OVER (PARTITION BY artist_name) AS artist_tracks FROM songs""")
def jn8_win5_lookups(songs):
    affinity = F.create_map(F.lit("pop"), F.lit(0.9), F.lit("rock"), F.lit(0.6))
    counts = songs.groupBy("artist_name").agg(F.count("*").alias("artist_tracks"))
    return songs.join(counts, "artist_name").select("rec_id", F.coalesce(affinity[F.col("genre")], F.lit(0.5)).alias("affinity"), "artist_tracks")


@query("song_status", """
WITH latest AS (SELECT song_id, arg_max(processing_status, (status_ts, seq)) AS status, max(status_ts) AS at FROM song_status GROUP BY 1),
done AS (SELECT song_id, count(*) AS n FROM song_status WHERE processing_status = 'completed' GROUP BY 1)
SELECT l.song_id, l.status, CASE WHEN d.n IS NOT NULL THEN 'ready' WHEN l.status = 'failed' THEN 'failed' ELSE 'waiting' END AS state,
  CASE l.status WHEN 'pending' THEN 10 WHEN 'processing' THEN 60 WHEN 'completed' THEN 100 ELSE 0 END AS progress
FROM latest l LEFT JOIN done d USING (song_id)""")
def jn12_jn13_st1_st2_song_state(song_status):
    latest = song_status.groupBy("song_id").agg(F.max_by("processing_status", F.struct("status_ts", "seq")).alias("status"))
    done = song_status.where("processing_status = 'completed'").groupBy("song_id").agg(F.count("*").alias("n"))
    progress = F.when(F.col("status") == "pending", 10).when(F.col("status") == "processing", 60).when(F.col("status") == "completed", 100).otherwise(0)
    return latest.join(done, "song_id", "left").select(
        "song_id", "status", F.when(F.col("n").isNotNull(), "ready").when(F.col("status") == "failed", "failed").otherwise("waiting").alias("state"), progress.alias("progress"))


@query("songs", "WITH p AS (SELECT genre, arg_min(platform, (-n, platform)) AS best FROM (SELECT genre, platform, count(*) AS n FROM songs GROUP BY ALL) GROUP BY 1) SELECT genre, count(*) AS n, round(avg(energy), 5) AS energy, round(avg(valence), 5) AS valence, any_value(p.best) AS platform, round(median(energy), 6) AS mid, count(DISTINCT artist_name) AS artists, bool_or(spotify) AS any_spotify, count(*) FILTER (WHERE energy >= 0.7) AS lively, list_sort(list(DISTINCT platform)) AS platforms, round(sum(avg_popularity), 4) AS total FROM songs JOIN p USING (genre) GROUP BY genre HAVING count(*) >= 5")
def agg1_agg13_flt8_genre_measures(songs):
    return songs.groupBy("genre").agg(
        F.count("*").alias("n"), F.round(F.avg("energy"), 5).alias("energy"), F.round(F.avg("valence"), 5).alias("valence"), stats.mode_of("platform").alias("platform"), F.round(F.median("energy"), 6).alias("mid"),
        F.countDistinct("artist_name").alias("artists"), F.bool_or("spotify").alias("any_spotify"), F.count_if(F.col("energy") >= 0.7).alias("lively"), F.sort_array(F.collect_set("platform")).alias("platforms"),
        F.round(F.sum("avg_popularity"), 4).alias("total")).where("n >= 5")


@query("songs", """
SELECT artist_name, arg_min(rec_id, (source_priority, rec_id)) AS first_record, arg_max(rec_id, (coalesce(energy, -1), rec_id)) AS liveliest FROM songs GROUP BY 1""")
def agg6_agg7_base_rows(songs):
    scored = songs.withColumn("e", F.coalesce("energy", F.lit(-1.0)))
    return scored.groupBy("artist_name").agg(F.min_by("rec_id", F.struct("source_priority", "rec_id")).alias("first_record"), stats.best_row(["rec_id"], "e", "rec_id")["rec_id"].alias("liveliest"))


@query("songs", """
WITH c AS (SELECT artist_name, genre, count(*) AS n FROM songs GROUP BY ALL) SELECT artist_name, list(genre ORDER BY n DESC, genre) AS "values" FROM c GROUP BY 1""")
def agg10_frequent_genres(songs):
    return stats.frequent_values(songs, "artist_name", "genre")


@query("songs", """
SELECT artist_name, round(coalesce(avg(avg_popularity) FILTER (WHERE platform = 'spotify'), 0), 6) AS spotify, round(coalesce(avg(avg_popularity) FILTER (WHERE platform = 'tiktok'), 0), 6) AS tiktok,
  round(coalesce(avg(avg_popularity) FILTER (WHERE platform = 'youtube'), 0), 6) AS youtube FROM songs GROUP BY 1""")
def agg11_platform_pivot(songs):
    names = ["spotify", "tiktok", "youtube"]
    plain = songs.select("artist_name", "platform", "avg_popularity")
    return stats.pivot_mean(plain, ["artist_name"], "platform", names, "avg_popularity").select("artist_name", *[F.round(n, 6).alias(n) for n in names])


@query("songs", f"""
SELECT feature, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS least, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50,
  round(quantile_cont(value, 0.75), 4) AS p75, max(value) AS most, count(*) - count(value) AS missing, round(sum((value - m) ** 3) / count(value) / (var_pop(value) ** 1.5), 4) AS skew,
  round(sum((value - m) ** 4) / count(value) / (var_pop(value) ** 2) - 3, 4) AS kurt
FROM (SELECT *, avg(value) OVER (PARTITION BY feature) AS m FROM ({_LONG})) GROUP BY feature""")
def agg14_agg16_agg21_val2_describe(songs):
    rounded = ("mean", "std", "p25", "p50", "p75", "skew", "kurt")
    return stats.describe(songs, FEATURES).withColumns({c: F.round(c, 4) for c in rounded})


@query("songs", f"SELECT platform, feature, round(corr(value, avg_popularity), 6) AS r, count(*) AS n FROM ({_LONG}) WHERE value IS NOT NULL AND avg_popularity IS NOT NULL GROUP BY ALL HAVING count(*) > 10 AND corr(value, avg_popularity) IS NOT NULL")
def agg17_platform_affinity(songs):
    return stats.correlations(songs, ["platform"], FEATURES, "avg_popularity").withColumn("r", F.round("r", 6))


@query("songs", f"""
WITH c AS (SELECT platform, feature, corr(value, avg_popularity) AS r FROM ({_LONG}) WHERE value IS NOT NULL AND avg_popularity IS NOT NULL GROUP BY ALL),
k AS (SELECT *, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign, row_number() OVER (PARTITION BY platform, r > 0 ORDER BY abs(r) DESC, feature) AS rank FROM c WHERE r <> 0)
SELECT platform, sign, feature, CAST(rank AS INT) AS rank FROM k WHERE rank <= 3""")
def top3_signed_correlations(songs):
    found = stats.correlations(songs, ["platform"], FEATURES, "avg_popularity")
    return stats.top_correlations(found, ["platform"]).select("platform", "sign", "feature", "rank")


@query("songs", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM songs" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]))
def agg18_val6_correlation_matrix(songs):
    return stats.correlation_matrix(songs, FEATURES).withColumn("r", F.round("r", 6))


@query("songs", """
WITH e AS (SELECT min(tempo) lo, max(tempo) hi FROM songs) SELECT CAST(least(floor((tempo - lo) / (hi - lo) * 20), 19) AS INT) AS bin, count(*) AS n FROM songs, e WHERE tempo IS NOT NULL GROUP BY 1""")
def agg19_val21_tempo_histogram(songs):
    return stats.histogram(songs, "tempo")


@query("chart_metrics", """
WITH m AS (SELECT source_year, avg(CAST(youtube_likes AS DOUBLE)) AS likes, avg(CAST(spotify_popularity AS DOUBLE)) AS popularity FROM chart_metrics GROUP BY 1),
l AS (SELECT 'likes' AS feature, source_year, likes AS mean FROM m UNION ALL SELECT 'popularity', source_year, popularity FROM m),
b AS (SELECT feature, arg_min(mean, source_year) AS before, arg_max(mean, source_year) AS after FROM l GROUP BY 1)
SELECT feature, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS change, round((after - before) / before * 100, 6) AS percent,
  CASE WHEN after > before THEN 'increase' WHEN after < before THEN 'decrease' ELSE 'stable' END AS direction FROM b""")
def agg20_set2_year_over_year(chart_metrics):
    numbers = chart_metrics.select("source_year", F.col("youtube_likes").cast("double").alias("likes"), F.col("spotify_popularity").cast("double").alias("popularity"))
    out = stats.year_over_year(numbers, "source_year", ["likes", "popularity"])
    return out.withColumns({c: F.round(c, 6) for c in ("before", "after", "change", "percent")})


@query("songs", "SELECT genre, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM songs), 6) AS share FROM songs GROUP BY 1")
def agg22_market_share(songs):
    return stats.share_of_total(songs, "genre").withColumn("share", F.round("share", 6))


@query("songs", "SELECT sum(CAST(spotify AS INT)) AS spotify, sum(CAST(tiktok AS INT)) AS tiktok, sum(CAST(youtube AS INT)) AS youtube, count(*) FILTER (WHERE source_count > 1) AS multi, count(*) FILTER (WHERE source_count = 1) AS single FROM songs")
def agg23_coverage(songs):
    return songs.agg(*[F.sum(F.col(p).cast("int")).alias(p) for p in ("spotify", "tiktok", "youtube")], F.count_if(F.col("source_count") > 1).alias("multi"), F.count_if(F.col("source_count") == 1).alias("single"))


@query("songs", """
WITH g AS (SELECT genre, count(*) AS n, round(avg(normalized_popularity), 6) AS engagement FROM songs GROUP BY 1)
SELECT genre, n, engagement, round(n * 100.0 / (SELECT sum(n) FROM g), 6) AS percent FROM g ORDER BY n DESC, genre LIMIT 3""")
def agg24_ins17_dashboard(songs):
    genres = songs.groupBy("genre").agg(F.count("*").alias("n"), F.round(F.avg("normalized_popularity"), 6).alias("engagement"))
    total = genres.agg(F.sum("n").alias("total"))
    return genres.crossJoin(F.broadcast(total)).select("genre", "n", "engagement", F.round(F.col("n") * 100 / F.col("total"), 6).alias("percent")).orderBy(F.desc("n"), "genre").limit(3)


@query("songs", "SELECT rec_id, n > 1 AS is_cross_platform FROM songs JOIN (SELECT artist_name, count(DISTINCT platform) AS n FROM songs GROUP BY 1) USING (artist_name)")
def win1_cross_platform(songs):
    counts = songs.groupBy("artist_name").agg(F.countDistinct("platform").alias("n"))
    return songs.join(counts, "artist_name").select("rec_id", (F.col("n") > 1).alias("is_cross_platform"))


@query("chart_metrics", """
WITH v AS (SELECT chart_id, CAST(youtube_likes AS DOUBLE) AS likes FROM chart_metrics), p AS (SELECT chart_id, likes, rank() OVER (ORDER BY likes) AS r, count(*) OVER (PARTITION BY likes) AS c, count(*) OVER () AS n FROM v WHERE likes > 0)
SELECT v.chart_id, round(coalesce((p.r + (p.c - 1) / 2.0) / p.n * 100, 0), 6) AS percentile FROM v LEFT JOIN p USING (chart_id)""")
def win2_ds7_percentiles(chart_metrics):
    likes = chart_metrics.select("chart_id", F.col("youtube_likes").cast("double").alias("likes"))
    return stats.percent_rank_nonzero(likes, "chart_id", "likes").withColumn("percentile", F.round("percentile", 6))


@query("stream_users", "SELECT user_id, age, country FROM (SELECT *, row_number() OVER (PARTITION BY trim(user_id) ORDER BY CAST(age AS INT), country, user_id) AS n FROM stream_users) WHERE n = 1")
def win4_first_per_user(stream_users):
    keyed = stream_users.withColumn("key", F.trim("user_id"))
    return tables.first_per_key(keyed, ["key"], [F.col("age").cast("int"), F.col("country"), F.col("user_id")]).select("user_id", "age", "country")


@query("songs", """
WITH g AS (SELECT genre, avg(energy) AS mean FROM songs GROUP BY 1), a AS (SELECT min(tempo) AS lo, max(tempo) AS hi, median(valence) AS mid FROM songs)
SELECT rec_id, round(coalesce(energy, mean), 6) AS energy, round((tempo - lo) / (hi - lo), 6) AS tempo_scaled, round(abs(valence - mid), 6) AS off_median FROM songs JOIN g USING (genre), a""")
def win6_win7_group_figures(songs):
    groups = songs.groupBy("genre").agg(F.avg("energy").alias("mean"))
    middle = quantiles.quantile_row(songs, ["valence"], (0.5,)).select(F.col("valence")[0].alias("mid"))
    row = songs.agg(F.min("tempo").alias("lo"), F.max("tempo").alias("hi")).crossJoin(F.broadcast(middle))
    return songs.join(groups, "genre").crossJoin(F.broadcast(row)).select(
        "rec_id", F.round(F.coalesce("energy", "mean"), 6).alias("energy"), F.round((F.col("tempo") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("tempo_scaled"), F.round(F.abs(F.col("valence") - F.col("mid")), 6).alias("off_median"))


@query("songs", "SELECT rec_id, avg_popularity FROM songs ORDER BY avg_popularity DESC NULLS LAST, rec_id LIMIT 20")
def top1_most_popular(songs):
    return songs.orderBy(F.desc_nulls_last("avg_popularity"), "rec_id").limit(20).select("rec_id", "avg_popularity")


@query("songs", """
SELECT rec_id, platform FROM (SELECT rec_id, platform, row_number() OVER (PARTITION BY platform ORDER BY avg_popularity DESC NULLS LAST, rec_id) AS n, count(*) OVER (PARTITION BY platform) AS c FROM songs) WHERE n <= c // 4""")
def top2_top_quarter(songs):
    songs = songs.select("rec_id", "platform", "avg_popularity")
    return tables.top_fraction(songs, "platform", [F.desc_nulls_last("avg_popularity"), F.col("rec_id")]).select("rec_id", "platform")


@query("song_status", "SELECT song_id, seq, status_ts FROM song_status ORDER BY status_ts DESC, seq DESC LIMIT 50")
def top4_top7_newest_first(song_status):
    return song_status.orderBy(F.desc("status_ts"), F.desc("seq")).limit(50).select("song_id", "seq", "status_ts")


@query("songs", """
WITH scored AS (SELECT rec_id, round(energy * 100, 4) AS a, round(valence * 100, 4) AS b, round(danceability * 100, 4) AS c FROM songs WHERE energy IS NOT NULL AND danceability IS NOT NULL)
SELECT rec_id, CASE WHEN a >= b AND a >= c THEN 'energy' WHEN b >= c THEN 'valence' ELSE 'danceability' END AS best FROM scored""")
def top5_top6_best_feature(songs):
    from resona.functions.numeric import best_of

    kept = songs.where("energy IS NOT NULL AND danceability IS NOT NULL")
    return kept.select("rec_id", best_of({n: F.round(F.col(n) * 100, 4) for n in ("energy", "valence", "danceability")}).alias("best"))


@query("tracks stream_users", """
SELECT rec_id AS id, genre, NULL AS country FROM tracks WHERE source_dataset = 'youtube' UNION ALL SELECT trim(user_id), NULL, country FROM stream_users""")
def set1_union_by_name(tracks, stream_users):
    return tables.union_all(tracks.where("source_dataset = 'youtube'").select(F.col("rec_id").alias("id"), "genre"), stream_users.select(F.trim("user_id").alias("id"), "country"))


@query("social_trends", "SELECT DISTINCT platform, trend_type, genre FROM social_trends EXCEPT SELECT platform, trend_type, genre FROM social_trends WHERE genre = 'none'")
def set3_set4_distinct_difference(social_trends):
    three = social_trends.select("platform", "trend_type", "genre")
    return three.distinct().exceptAll(three.where("genre = 'none'").distinct())


@query("chart_metrics", "SELECT count(*) - count(DISTINCT (spotify_playlist_reach, youtube_likes)) AS duplicates FROM chart_metrics")
def set6_duplicate_rows(chart_metrics):
    return tables.duplicate_rows(chart_metrics.select("spotify_playlist_reach", "youtube_likes"))


@query("songs", "SELECT rec_id, platform FROM (SELECT rec_id, platform, row_number() OVER (PARTITION BY platform ORDER BY rec_id) AS n FROM songs) WHERE n <= 100 // 4")
def src8_stratified_sample(songs):
    return tables.stratified_sample(songs, "platform", "rec_id", 100, 4, seed=None).select("rec_id", "platform")


@query("songs", """
SELECT rec_id, 'uniform' AS kind FROM (SELECT rec_id FROM songs ORDER BY md5(rec_id || ':42'), rec_id LIMIT 200)
UNION ALL SELECT rec_id, CASE WHEN CAST('0x' || substr(md5(rec_id || ':42'), 1, 8) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END FROM songs""")
def src7_src9_ml22_samples(songs):
    train, test = tables.split_by_hash(songs, "rec_id")
    return tables.union_all(
        tables.uniform_sample(songs, "rec_id", 200).select("rec_id", F.lit("uniform").alias("kind")), train.select("rec_id", F.lit("train").alias("kind")), test.select("rec_id", F.lit("test").alias("kind")))


@query("song_status", """
SELECT song_id, seq, processing_status, CAST(floor(epoch(status_ts)) - floor(epoch(lag(status_ts) OVER (PARTITION BY song_id ORDER BY status_ts, seq))) AS BIGINT) AS seconds FROM song_status""")
def st5_processing_seconds(song_status):
    at = F.unix_timestamp(F.col("status_ts").cast("timestamp"))
    run = Window.partitionBy("song_id").orderBy("status_ts", "seq")
    return song_status.select("song_id", "seq", "processing_status", (at - F.lag(at).over(run)).alias("seconds"))


_RANGES = {"danceability": (0.0, 0.9), "energy": (0.1, 1.0), "tempo": (50.0, 250.0), "loudness": (-60.0, 0.0)}


@query("songs", " UNION ALL ".join(f"""SELECT '{f}' AS feature, count(*) FILTER (WHERE {f} < {lo}) AS below, count(*) FILTER (WHERE {f} > {hi}) AS above, round(count(*) FILTER (WHERE {f} BETWEEN {lo} AND {hi}) * 100.0 / count({f}), 6) AS within,
  CASE WHEN count(*) FILTER (WHERE {f} BETWEEN {lo} AND {hi}) * 100.0 / count({f}) < 90 THEN 'high' WHEN count(*) FILTER (WHERE {f} BETWEEN {lo} AND {hi}) * 100.0 / count({f}) < 95 THEN 'medium' ELSE 'none' END AS severity FROM songs""" for f, (lo, hi) in _RANGES.items()))
def val3_range_violations(songs):
    return stats.range_violations(songs, _RANGES).withColumn("within", F.round("within", 6))


@query("songs", f"""
WITH long AS ({_LONG}), q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1),
c AS (SELECT feature, count(*) FILTER (WHERE value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5) AS outliers, count(*) AS n FROM long JOIN q USING (feature) WHERE value IS NOT NULL GROUP BY 1)
SELECT feature, outliers, round(outliers * 100.0 / n, 6) AS percent, outliers * 100.0 / n > 5 AS flagged FROM c""")
def val4_iqr_outliers(songs):
    return stats.iqr_outliers(songs, FEATURES).withColumn("percent", F.round("percent", 6))


@query("tracks", """
WITH m AS (SELECT avg(popularity_score) AS mean, stddev_samp(popularity_score) AS std FROM tracks)
SELECT rec_id, 'popularity_score' AS feature, popularity_score AS value, round((popularity_score - mean) / std, 6) AS z FROM tracks, m WHERE abs((popularity_score - mean) / std) > 3""")
def val5_sigma_anomalies(tracks):
    return stats.sigma_anomalies(tracks, "rec_id", ["popularity_score"]).withColumn("z", F.round("z", 6))


@query("songs", """
SELECT unnest(['rows','artists','tracks','genres','on_spotify','on_tiktok','on_youtube','multi_platform','popular','middling','obscure','complete_energy','complete_genre']) AS metric,
 unnest([count(*), count(DISTINCT artist_name), count(DISTINCT track_name), count(DISTINCT genre), count(*) FILTER (WHERE spotify), count(*) FILTER (WHERE tiktok), count(*) FILTER (WHERE youtube),
 count(*) FILTER (WHERE CAST(spotify AS INT) + CAST(tiktok AS INT) + CAST(youtube AS INT) > 1), count(*) FILTER (WHERE normalized_popularity >= 70), count(*) FILTER (WHERE normalized_popularity >= 40 AND normalized_popularity < 70),
 count(*) FILTER (WHERE normalized_popularity < 40), round(count(energy) * 100.0 / count(*), 6), round(count(genre) * 100.0 / count(*), 6)]::DOUBLE[]) AS value FROM songs""")
def val1_val16_overview(songs):
    return stats.overview(songs, ["spotify", "tiktok", "youtube"], ["energy", "genre"]).withColumn("value", F.round("value", 6))


@query("songs", """
SELECT round(var_samp(energy) FILTER (WHERE source_count > 1) / var_samp(energy) FILTER (WHERE source_count = 1), 6) AS ratio,
  count(*) FILTER (WHERE normalized_popularity < 0 OR normalized_popularity > 100) AS outside, count(*) FILTER (WHERE NOT spotify AND NOT tiktok AND NOT youtube) AS nowhere,
  CASE WHEN count(*) FILTER (WHERE NOT spotify AND NOT tiktok AND NOT youtube) > 0 THEN 'WARN' ELSE 'PASS' END AS state FROM songs""")
def val7_val18_consistency(songs):
    one, many = F.var_samp(F.when(F.col("source_count") == 1, F.col("energy"))), F.var_samp(F.when(F.col("source_count") > 1, F.col("energy")))
    nowhere = F.count_if(~F.col("spotify") & ~F.col("tiktok") & ~F.col("youtube"))
    return songs.agg(
        F.round(F.when(one > 0, many / one).otherwise(1.0), 6).alias("ratio"), F.count_if(~F.col("normalized_popularity").between(0, 100)).alias("outside"), nowhere.alias("nowhere"),
        F.when(nowhere > 0, "WARN").otherwise("PASS").alias("state"))


@query("stream_users", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_percent, count(DISTINCT {c}) AS \"distinct\" FROM stream_users" for c in ("user_id", "country", "platform", "subscription")))
def val22_cleaner_report(stream_users):
    return stats.null_report(stream_users, ["user_id", "country", "platform", "subscription"]).withColumn("missing_percent", F.round("missing_percent", 6))


@query("labels", """
WITH t AS (SELECT sum(CAST(quality = toxic AS INT)) * 1.0 / count(*) AS accuracy FROM labels)
SELECT quality AS class, round(coalesce(count(*) FILTER (WHERE toxic = quality) * 1.0 / (SELECT count(*) FROM labels l WHERE l.toxic = labels.quality), 0), 6) AS precision,
  round(count(*) FILTER (WHERE toxic = quality) * 1.0 / count(*), 6) AS recall, count(*) AS support, round(any_value(accuracy), 6) AS accuracy FROM labels, t GROUP BY quality""")
def ml23_class_metrics(labels):
    return stats.classification_metrics(labels, "quality", "toxic").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "accuracy")})


@query("songs", """
SELECT round(avg(abs(energy - valence)), 6) AS mae, round(1 - sum((energy - valence) ** 2) / (var_pop(energy) * count(energy)), 6) AS r2, round(avg(CASE WHEN energy <> 0 THEN abs((energy - valence) / energy) * 100 END), 4) AS mape
FROM songs WHERE energy IS NOT NULL""")
def ml23_regression_metrics(songs):
    return stats.regression_metrics(songs.where("energy IS NOT NULL"), "energy", "valence").select(F.round("mae", 6).alias("mae"), F.round("r2", 6).alias("r2"), F.round("mape", 4).alias("mape"))


_GRADED = ["danceability", "energy", "valence", "acousticness", "speechiness"]
_FIELDS = ["track_name", "artist_name", "normalized_popularity", *_GRADED]
_ALL = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value FROM songs WHERE {f} IS NOT NULL" for f in _GRADED)


@query("songs", f"""
WITH long AS ({_ALL}), q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS mean, stddev_samp(value) AS std FROM long GROUP BY 1),
o AS (SELECT feature, any_value(mean) AS mean, any_value(std) AS std, count(*) FILTER (WHERE value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5) * 100.0 / count(*) AS percent FROM long JOIN q USING (feature) GROUP BY 1),
f AS (SELECT avg(greatest(0.0, 100 - std / mean * 50 - percent * 2)) AS feature_quality FROM o),
c AS (SELECT ({' + '.join(f'count({c}) * 100.0 / count(*)' for c in _FIELDS)}) / {len(_FIELDS)} AS completeness,
  greatest(0.0, 100 - 10 * ({' + '.join(f'count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) * 1.0 / count({c})' for c, (lo, hi) in _RANGES.items())})) AS consistency,
  least(100.0, count(*) FILTER (WHERE source_count > 1) * 100.0 / count(*) + avg(source_count) * 10) AS diversity,
  (count(*) FILTER (WHERE spotify) + count(*) FILTER (WHERE tiktok) + count(*) FILTER (WHERE youtube)) * 100.0 / count(*) / 3 AS coverage FROM songs),
r AS (SELECT round(completeness, 2) AS data_completeness, round(consistency, 2) AS data_consistency, round(diversity, 2) AS source_diversity, round(coverage, 2) AS platform_coverage, round(feature_quality, 2) AS feature_quality FROM c, f),
w AS (SELECT *, data_completeness * 0.3 + data_consistency * 0.25 + source_diversity * 0.2 + platform_coverage * 0.15 + feature_quality * 0.1 AS total FROM r)
SELECT data_completeness, data_consistency, source_diversity, platform_coverage, feature_quality, round(total, 2) AS overall,
  CASE WHEN total >= 90 THEN 'Excellent' WHEN total >= 80 THEN 'Good' WHEN total >= 70 THEN 'Fair' WHEN total >= 60 THEN 'Poor' ELSE 'Critical' END AS category FROM w""")
def val14_quality_components(songs):
    return stats.quality_components(songs, _FIELDS, _RANGES, _GRADED, ["spotify", "tiktok", "youtube"])
