"""Queries over matching, models, similarity, insights, audio descriptors and song status."""

from __future__ import annotations

from pyspark.sql import functions as F

from resona.functions import fuzzy
from resona.functions import text as T
from resona.operators import audio, insights, matching, models, quantiles, scores, stats, tables
from resona.plans.query import query
from resona.plans.scoring import _fit
from resona.streaming import status

FEATURES = ["danceability", "energy", "valence", "acousticness", "instrumentalness", "liveness", "speechiness"]
_COMPLETE = "danceability IS NOT NULL AND energy IS NOT NULL"
_APPEAL = "(SELECT *, (energy * 0.3 + valence * 0.3 + danceability * 0.4) * 100 AS audio_appeal FROM songs WHERE danceability IS NOT NULL AND energy IS NOT NULL)"


def _ready(songs):
    return songs.where(_COMPLETE).withColumn("audio_appeal", scores.audio_appeal())


@query("part", """
WITH names AS (SELECT DISTINCT p_name AS name FROM part)
SELECT x.name AS a, y.name AS b FROM names x JOIN names y ON x.name < y.name WHERE (1 - levenshtein(x.name, y.name)::DOUBLE / greatest(length(x.name), length(y.name))) * 100 >= 70""")
def er2_er3_blocked_edit_pairs(part):
    names = part.select(F.col("p_name").alias("name"))
    return matching.scored_pairs(matching.near_pairs(names, names, "name", 70, "edit").where("a < b"), 70, "edit").select("a", "b")


@query("part")
def er5_leader_groups(part):
    names = part.select(F.col("p_name").alias("name"))
    edges = matching.scored_pairs(matching.near_pairs(names, names, "name", 85).where("a < b"), 85, "ratio")
    return matching.leader_groups(names, "name", edges)


@query("songs")
def er12_merged_spellings(songs):
    """Songs whose cleaned artists and tracks, digits left out, agree at 95 become one row around the best-scored one."""
    clean = lambda name: F.trim(F.regexp_replace(T.dedup_key(name), "[0-9]+", ""))
    keyed = songs.withColumn("song", T.composite_key(F.col("artist_name"), F.col("track_name"), clean))
    merged = matching.merge_similar(keyed, "song", ["energy", "danceability", "valence", "acousticness", "instrumentalness"])
    return merged.select("song", "merged", F.round("energy", 6).alias("energy"), F.col("normalized_popularity").alias("popularity"), "genre", "tiktok")


@query("part supplier")
def er4_er6_er7_er15_jn9_jn10_win3_best_matches(part, supplier):
    left = part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("name"))
    right = part.where("p_partkey % 2 = 1").select(F.col("p_name").alias("name"))
    forward, backward = matching.best_matches(left, right, "name"), matching.best_matches(right, left, "name")
    report = matching.match_report(forward).select(F.col("confidence").alias("a"), F.col("matches").cast("string").alias("b"), F.col("mean").alias("score"))
    return matching.mutual_best(forward, backward).select("a", "b", "score").union(report)


@query("part")
def er4_er8_score_pairs(part):
    """Brands stand for artists: every two songs whose artists and tracks both reach 70, with both predicates."""
    songs = part.select(F.col("p_brand").alias("artist"), F.col("p_name").alias("track")).distinct()
    return matching.likely_pairs(songs).select("artist_a", "track_a", "artist_b", "track_b", F.round("weighted", 6).alias("weighted"), "strict", "lenient")


@query("tracks part")
def er16_fuzzy_search(tracks, part):
    asked = part.where("p_partkey % 100 = 0").select(F.lower("p_name").alias("q"))
    return matching.search(tracks.select("track_name", "artist_name", "popularity_score"), asked, ["track_name", "artist_name"], "popularity_score").select("q", "track_name", "artist_name", "score", "rank")


_SCALED = ", ".join(f"round((coalesce({c}, m_{c}) - m_{c}) / s_{c}, 6) AS {c}" for c in FEATURES[:3])


@query("songs", f"SELECT rec_id, {_SCALED} FROM songs, (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES[:3])} FROM songs)")
def ml1_ml3_standard_scaling(songs):
    return models.standardize(songs, FEATURES[:3]).select("rec_id", *[F.round(f"{c}_scaled", 6).alias(c) for c in FEATURES[:3]])


@query("songs", "WITH q AS (SELECT quantile_cont(tempo, 0.25) AS a, quantile_cont(tempo, 0.5) AS b, quantile_cont(tempo, 0.75) AS c FROM songs) SELECT rec_id, round((tempo - b) / (c - a), 6) AS tempo FROM songs, q")
def ml2_robust_scaling(songs):
    return models.robust_scale(songs, ["tempo"]).select("rec_id", F.round("tempo_scaled", 6).alias("tempo"))


@query("songs")
def ml4_ml15_sound_clusters(songs):
    _, labelled = models.cluster(tables.settled(_ready(songs).select("rec_id", *FEATURES[:4])), FEATURES[:4], 4)
    near = models.nearest_songs(labelled, "rec_id").groupBy("cluster").agg(F.sort_array(F.collect_list("rec_id")).alias("examples"))
    return models.sound_profiles(labelled, FEATURES[:4]).join(near, "cluster")


@query("songs")
def ml5_ml6_ml16_cluster_choice(songs):
    ready = tables.settled(_ready(songs).select(*FEATURES))
    k, costs = models.elbow(ready, FEATURES[:4], most=6)
    _, labelled = models.cluster(ready, FEATURES[:4], k)
    model, _ = models.project(ready, FEATURES)
    return songs.sparkSession.createDataFrame([("k", float(k)), ("silhouette", float(models.silhouette(labelled))), ("components", float(model.getK())), *[(f"cost_{i + 2}", float(c)) for i, c in enumerate(costs)]], "metric string, value double")


@query("songs")
def ml17_ml25_platform_models(songs):
    ready = _ready(songs).withColumn("label", (F.col("normalized_popularity") > 45).cast("double")).where("label IS NOT NULL")
    held = tables.held_out("rec_id")  # ids are kept of the rows that are answered
    ready = tables.settled(ready.select(held.alias("held"), F.when(held, F.col("rec_id")).alias("rec_id"), *FEATURES, "normalized_popularity", "label"))
    train, test = ready.where("NOT held"), ready.where("held")
    chosen = models.forest_classifier(train, FEATURES, "label", trees=20, depth=6)
    level = models.forest_regressor(train.where("label = 1"), FEATURES, "normalized_popularity", trees=20, depth=6)
    scored = models.answered(test, FEATURES, [chosen, level], ["probability", "expected"])
    both = models.class_probabilities(scored, ["other", "success"])
    fit = insights.platform_fits()["tiktok_fit"]
    return both.select("rec_id", "best", "confidence", models.two_stage(F.col("class_map")["success"], F.col("expected"), fit).alias("score"))


@query("chart_metrics", """
WITH p AS (SELECT count(*) FILTER (WHERE CAST(youtube_likes AS DOUBLE) > 5) * 100.0 / count(*) AS share FROM chart_metrics)
SELECT round(share, 6) AS share, CASE WHEN share < 10 THEN 'two-stage' WHEN share < 30 THEN 'weighted' ELSE 'regression' END AS approach FROM p""")
def ml26_zero_inflation(chart_metrics):
    share = F.count_if(F.col("youtube_likes").cast("double") > 5) * 100 / F.count("*")
    return chart_metrics.agg(share.alias("s")).select(F.round("s", 6).alias("share"), F.when(F.col("s") < 10, "two-stage").when(F.col("s") < 30, "weighted").otherwise("regression").alias("approach"))


@query("songs", """
WITH v AS (SELECT track_name, artist_name, (max(normalized_popularity) * 0.4 + avg(normalized_popularity) * 0.3 + count(normalized_popularity) * 10.0) AS score FROM songs GROUP BY ALL), e AS (SELECT min(score) AS lo, max(score) AS hi FROM v)
SELECT CAST(least(greatest(ceil((score - lo) / ((hi - lo) / 3)), 1), 3) AS INT) AS tier, count(*) AS n FROM v, e WHERE score IS NOT NULL GROUP BY 1""")
def ml27_success_tiers(songs):
    from resona.functions.numeric import equal_width_bin

    score = F.max("normalized_popularity") * 0.4 + F.avg("normalized_popularity") * 0.3 + F.count("normalized_popularity") * 10.0
    scored = songs.groupBy("track_name", "artist_name").agg(score.alias("score")).where("score IS NOT NULL")
    ends = scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return scored.crossJoin(F.broadcast(ends)).groupBy(equal_width_bin(F.col("score"), F.col("lo"), F.col("hi"), 3).alias("tier")).agg(F.count("*").alias("n"))


@query("songs", """
WITH q AS (SELECT quantile_cont(avg_popularity, 0.8) AS cut FROM songs)
SELECT platform, count(*) AS n, round(avg(energy), 6) AS energy, round(median(valence), 6) AS valence, round(stddev_samp(tempo), 6) AS tempo_spread FROM songs, q WHERE avg_popularity >= cut GROUP BY 1 HAVING count(*) > 5""")
def ml28_success_patterns(songs):
    cut = quantiles.quantile_row(songs, ["avg_popularity"], (0.8,)).select(F.col("avg_popularity")[0].alias("cut"))
    top = songs.crossJoin(F.broadcast(cut)).where("avg_popularity >= cut")
    return top.groupBy("platform").agg(F.count("*").alias("n"), F.round(F.avg("energy"), 6).alias("energy"), F.round(F.median("valence"), 6).alias("valence"), F.round(F.stddev_samp("tempo"), 6).alias("tempo_spread")).where("n > 5")


_LONG = " UNION ALL ".join(f"SELECT platform, rec_id, avg_popularity, '{f}' AS feature, {f} AS value FROM songs" for f in FEATURES[:4])


@query("songs", f"""
WITH long AS ({_LONG}), a AS (SELECT platform, feature, corr(value, avg_popularity) AS r FROM long WHERE value IS NOT NULL AND avg_popularity IS NOT NULL GROUP BY ALL HAVING count(*) > 10 AND corr(value, avg_popularity) IS NOT NULL),
p AS (SELECT l.rec_id, a.platform, sum(l.value * a.r) AS score FROM long l JOIN a USING (feature) GROUP BY ALL) SELECT rec_id, platform, round(score, 6) AS score FROM p WHERE score IS NOT NULL""")
def ml29_weighted_prediction(songs):
    affinity = stats.correlations(songs, ["platform"], FEATURES[:4], "avg_popularity")
    return insights.predicted_platforms(songs, affinity, FEATURES[:4]).where("score IS NOT NULL").select("rec_id", "platform", F.round("score", 6).alias("score"))


_ADVICE = " ".join(f"WHEN '{p}' THEN [{', '.join(chr(39) + t + chr(39) for t in lines)}]" for p, lines in insights.PLATFORM_ADVICE.items())


@query("songs", f"""
WITH s AS (SELECT platform, {', '.join(FEATURES[:4])}, (energy * 0.3 + valence * 0.3 + danceability * 0.4) * 100 AS appeal FROM songs WHERE danceability IS NOT NULL AND energy IS NOT NULL),
a AS ({' UNION ALL '.join(f"SELECT platform, '{f}' AS feature, round(corr({f}, appeal), 6) AS r FROM s WHERE {f} IS NOT NULL GROUP BY 1 HAVING count(*) > 10" for f in FEATURES[:4])})
SELECT platform, coalesce(list(feature ORDER BY feature) FILTER (WHERE abs(r) > 0.3), []) AS features, coalesce(list(CASE WHEN abs(r) > 0.5 THEN 'high' ELSE 'moderate' END ORDER BY feature) FILTER (WHERE abs(r) > 0.3), []) AS importance,
  CASE platform {_ADVICE} ELSE [] END AS strategies FROM a WHERE r IS NOT NULL GROUP BY platform""")
def ins11_platform_strategies(songs):
    affinity = stats.correlations(_ready(songs), ["platform"], FEATURES[:4], "audio_appeal").withColumn("r", F.round("r", 6))
    listed = lambda name: F.transform("primary_features", lambda x: x[name])
    return insights.platform_strategies(affinity).select("platform", listed("feature").alias("features"), listed("importance").alias("importance"), "strategies")


@query("songs", """
WITH g AS (SELECT artist_name, arg_min(genre, (-n, genre)) AS genre FROM (SELECT artist_name, genre, count(*) AS n FROM songs GROUP BY ALL) GROUP BY 1),
p AS (SELECT artist_name, arg_min(platform, (-n, platform)) AS platform FROM (SELECT artist_name, platform, count(*) AS n FROM songs GROUP BY ALL) GROUP BY 1)
SELECT artist_name, round(avg(energy), 9) AS energy, round(avg(valence), 9) AS valence, any_value(g.genre) AS genre, any_value(p.platform) AS platform, round(avg(normalized_popularity), 9) AS popularity, count(*) AS tracks, count(DISTINCT songs.platform) > 1 AS multi
FROM songs JOIN g USING (artist_name) JOIN p USING (artist_name) GROUP BY 1""")
def sim1_sim6_artist_profiles(songs):
    return models.artist_profiles(songs, ["energy", "valence"]).withColumns({c: F.round(c, 9) for c in ("energy", "valence", "popularity")})


@query("embeddings", """
WITH s AS (SELECT q.vec_id AS query, i.vec_id AS item, list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS similarity FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS rank FROM s) SELECT query, item, CAST(rank AS INT) AS rank, round(similarity, 6) AS similarity FROM r WHERE rank <= 5""")
def sim2_sim4_cosine_neighbours(embeddings):
    found = models.top_similar(embeddings, "vec_id", "embedding")
    return found.select("query", "item", "rank", F.round("similarity", 6).alias("similarity"))


@query("embeddings", """
WITH s AS (SELECT q.vec_id AS query, i.vec_id AS item, list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS similarity FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 12) DESC, item) AS rank FROM s) SELECT query, item, CAST(rank AS INT) AS rank, round(similarity, 6) AS similarity FROM r WHERE rank <= 5""")
def sim3_similar_pairs(embeddings):
    return models.top_similar(embeddings, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


_FITS = {n: _fit(p) for n, p in scores.AGE_PROFILES.items()}
_MOST = f"greatest({', '.join(_FITS.values())})"


@query("songs", f"""
WITH q AS (SELECT rec_id, CASE {' '.join(f"WHEN {fit} = {_MOST} THEN '{n}'" for n, fit in _FITS.items())} END AS audience FROM songs),
f AS ({' UNION ALL '.join(f"SELECT '{n}' AS audience, rec_id AS item, {fit} AS score FROM songs" for n, fit in _FITS.items())}),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY audience ORDER BY score DESC, item) AS place FROM f) WHERE place <= 6),
r AS (SELECT q.rec_id AS query, audience, item, score, row_number() OVER (PARTITION BY q.rec_id ORDER BY score DESC, item) AS rank FROM q JOIN t USING (audience) WHERE item <> q.rec_id)
SELECT query, audience, item, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def sim7_similar_by_audience(songs):
    fits = {n: scores.profile_fit(p, digits=4) for n, p in scores.AGE_PROFILES.items()}
    return models.similar_by_best(songs, "rec_id", fits, k=5).withColumnRenamed("best", "audience")


@query("songs", """
SELECT a.rec_id AS rec_id, list_transform(list_sort(list_filter([{'m': abs(a.energy - b.energy) - 1, 'f': 'energy'}, {'m': abs(a.valence - b.valence) - 1, 'f': 'valence'}, {'m': abs(a.danceability - b.danceability) - 1, 'f': 'danceability'}], lambda x: x.m < -0.8)), lambda x: x.f)[1:2] AS alike
FROM songs a JOIN songs b ON a.rec_id < b.rec_id AND a.track_name = b.track_name WHERE a.energy IS NOT NULL AND b.energy IS NOT NULL AND a.danceability IS NOT NULL AND b.danceability IS NOT NULL""")
def sim5_key_similarities(songs):
    three = ["energy", "valence", "danceability"]
    ready = songs.where(_COMPLETE).select("rec_id", "track_name", *three)
    other = ready.select("track_name", F.col("rec_id").alias("other_id"), *[F.col(c).alias(f"other_{c}") for c in three])
    pairs = ready.join(other, "track_name").where("rec_id < other_id")
    return pairs.select("rec_id", F.transform(models.key_similarities(three, k=2), lambda x: x["feature"]).alias("alike"))


@query("songs", f"""
SELECT rec_id, round(valence * 0.25 + energy * 0.2 + acousticness * 0.2 + (1 - instrumentalness) * 0.2 + audio_appeal / 100 * 0.15, 6) AS spotify_fit,
  round(danceability * 0.4 + energy * 0.3 + CAST(speechiness > 0.1 AS INT) * 0.15 + valence * 0.15, 6) AS tiktok_fit, round(danceability * energy * (1 - instrumentalness), 6) AS hook_strength,
  round(CASE WHEN valence > 0.6 THEN valence * energy ELSE valence * 0.5 END, 6) AS mood_appeal, CAST(CASE WHEN tempo BETWEEN 100 AND 140 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS tempo_tiktok,
  CAST(CASE lower(genre) WHEN 'pop' THEN 0.8 WHEN 'hip hop' THEN 1.0 WHEN 'electronic' THEN 0.9 WHEN 'rock' THEN 0.4 WHEN 'country' THEN 0.5 WHEN 'r&b' THEN 0.7 WHEN 'indie' THEN 0.5 ELSE 0.7 END AS DOUBLE) AS genre_tiktok_fit FROM {_APPEAL}""")
def sc21_platform_fit_features(songs):
    fits = insights.platform_fits()
    rounded = ("spotify_fit", "tiktok_fit", "hook_strength", "mood_appeal")
    return _ready(songs).select("rec_id", *[F.round(fits[c], 6).alias(c) for c in rounded], fits["tempo_tiktok"].alias("tempo_tiktok"), fits["genre_tiktok_fit"].alias("genre_tiktok_fit"))


@query("songs", f"""
SELECT rec_id, round(danceability * 0.35 + energy * 0.25 + CAST(speechiness > 0.1 AS INT) * 0.15 + CAST(instrumentalness < 0.5 AS INT) * 0.25, 6) AS tiktok_viral_score,
  round(least(greatest((danceability * 0.35 + energy * 0.25 + CAST(speechiness > 0.1 AS INT) * 0.15 + CAST(instrumentalness < 0.5 AS INT) * 0.25) * 20, 0), 100), 6) AS tiktok_scaled FROM {_APPEAL}""")
def sc22_ml21_viral_features(songs):
    viral = insights.viral_fits()["tiktok_viral_score"]
    return _ready(songs).select("rec_id", F.round(viral, 6).alias("tiktok_viral_score"), F.round(insights.rescaled("tiktok", viral), 6).alias("tiktok_scaled"))


_GAPS = "(SELECT rec_id, danceability, energy, valence, instrumentalness, (energy * 0.3 + valence * 0.3 + danceability * 0.4) * 100 AS audio_appeal FROM songs)"


@query("songs", f"""
SELECT rec_id, CASE WHEN danceability > 0.7 THEN 'tiktok' WHEN valence > 0.6 THEN 'spotify' WHEN energy > 0.6 THEN 'youtube' ELSE 'spotify' END AS first_choice,
  round(least(100, coalesce(danceability, 0.5) * 40 + coalesce(energy, 0.5) * 35 + coalesce(valence, 0.5) * 25), 6) AS tiktok,
  round(least(100, coalesce(valence, 0.5) * 30 + coalesce(energy, 0.5) * 25 + coalesce(audio_appeal, 50) * 0.45), 6) AS spotify,
  round(least(100, coalesce(energy, 0.5) * 35 + coalesce(valence, 0.5) * 30 + (1 - coalesce(instrumentalness, 0.5)) * 35), 6) AS youtube FROM {_GAPS}""")
def sc24_sc25_ins7_fallback_platforms(songs):
    """All songs, those without features above all: their gaps count as the middle."""
    scored = insights.fallback_platforms()
    return songs.withColumn("audio_appeal", scores.audio_appeal()).select("rec_id", insights.basic_platforms()[0]["name"].alias("first_choice"), *[F.round(scored[p], 6).alias(p) for p in ("tiktok", "spotify", "youtube")])


def _case(group) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in group) + " END"


_SOUND = ", ".join(_case(g) for g in insights.SOUND_RULES)
_STRENGTH = ", ".join(_case(g) for g in insights.STRENGTH_RULES)
_ACTIONS = ", ".join(_case(g) for g in insights.ACTION_RULES)
_FOCUS = ", ".join(_case(g) for g in insights.FOCUS_RULES)


@query("songs", f"""
WITH t AS (SELECT *, list_filter([{_SOUND}], lambda x: x IS NOT NULL) AS sound, list_filter([{_STRENGTH}], lambda x: x IS NOT NULL) AS strong, list_filter([{_ACTIONS}], lambda x: x IS NOT NULL) AS acts FROM {_APPEAL})
SELECT rec_id, CASE WHEN len(sound) = 0 THEN 'balanced' ELSE array_to_string(sound[1:4], ', ') END AS sound_profile,
  CASE WHEN len(strong) > 0 THEN 'Key strengths: ' || array_to_string(strong, ', ') WHEN valence < 0.8 THEN 'Key strengths: distinctive sound profile' ELSE 'Well-balanced sound with broad appeal' END AS advantage,
  CASE WHEN energy > 0.7 THEN 'high' WHEN energy > 0.4 THEN 'medium' ELSE 'low' END AS confidence,
  ((CASE WHEN energy > 0.7 THEN 'HIGH' WHEN energy > 0.4 THEN 'MEDIUM' ELSE 'LOW' END || ' PRIORITY: ' || upper(platform[1]) || platform[2:]) || '; ' || array_to_string(acts, '; ')) AS actions FROM t""")
def ins1_ins2_ins3_ins5_song_texts(songs):
    actions = insights.action_items(F.col("platform"), F.col("energy"))
    return _ready(songs).select(
        "rec_id", insights.sound_profile().alias("sound_profile"), insights.competitive_advantage(F.col("valence")).alias("advantage"), insights.confidence_level(F.col("energy")).alias("confidence"),
        F.concat(actions[0], F.lit("; "), F.array_join(F.slice(actions, 2, 7), "; ")).alias("actions"))


def _first_best(fits: dict[str, str]) -> str:
    """SQL for the name of the largest score, the first of equals."""
    most = f"greatest({', '.join(fits.values())})"
    return "CASE " + " ".join(f"WHEN {fit} = {most} THEN '{n}'" for n, fit in fits.items()) + " END"


_LINEAR = {"tiktok": "least(danceability * 40 + energy * 35 + valence * 25, 100.0)", "spotify": "least(valence * 30 + energy * 25 + audio_appeal * 0.45, 100.0)", "youtube": "least(energy * 35 + valence * 30 + (1 - instrumentalness) * 35, 100.0)"}


@query("songs", f"""
SELECT rec_id, {_first_best({n: _fit(p, 2) for n, p in scores.AGE_PROFILES.items()})} AS audience, {_first_best(_LINEAR)} AS top_platform, {_first_best({n: _fit(p, 2) for n, p in scores.PLATFORM_PROFILES.items()})} AS best_profile,
  CASE WHEN len(list_filter([{_SOUND}], lambda x: x IS NOT NULL)) = 0 THEN 'balanced' ELSE array_to_string(list_filter([{_SOUND}], lambda x: x IS NOT NULL)[1:4], ', ') END AS sound,
  CAST(1 + len(list_filter([{_ACTIONS}], lambda x: x IS NOT NULL)) AS INT) AS n_actions, array_to_string(list_filter([{_FOCUS}], lambda x: x IS NOT NULL), ',') AS focus FROM {_APPEAL}""")
def ins6_ins9_ins15_ins16_song_insights(songs):
    found = insights.song_insights(_ready(songs))
    return found.select("rec_id", "audience", "top_platform", "best_profile", F.col("insights.sound").alias("sound"), F.size("insights.actions").alias("n_actions"), F.array_join("insights.focus", ",").alias("focus"))


@query("songs", """
WITH m AS (SELECT avg(energy) AS energy, avg(danceability) AS danceability, avg(valence) AS valence FROM songs WHERE energy > 0.5)
SELECT 'energy' AS feature, 'lead with energetic cuts' AS advice FROM m WHERE energy > 0.6 UNION ALL SELECT 'danceability', 'seed dance clips' FROM m WHERE danceability > 0.6 UNION ALL SELECT 'valence', 'place on upbeat lists' FROM m WHERE valence > 0.6""")
def ins10_ins14_strategies(songs):
    return insights.strategies(songs.where("energy > 0.5"))


@query("songs", """SELECT rec_id, array_to_string(list_filter([CASE WHEN energy > 0.7 THEN 'energy' END, CASE WHEN valence > 0.7 THEN 'valence' END, CASE WHEN danceability > 0.7 THEN 'danceability' END], lambda x: x IS NOT NULL), ', ') AS strongest FROM songs""")
def ins8_strongest_features(songs):
    return songs.select("rec_id", F.array_join(insights.rule_texts([[(f"{c} > 0.7", c)] for c in ("energy", "valence", "danceability")]), ", ").alias("strongest"))


@query("songs", "SELECT genre, round(avg(energy), 6) AS mean_energy, round(stddev_samp(energy), 6) AS std_energy FROM songs GROUP BY 1")
def snk4_flattened_export(songs):
    from resona.sources.sinks import flatten

    nested = songs.groupBy("genre").agg(F.struct(F.round(F.avg("energy"), 6).alias("energy")).alias("mean"), F.struct(F.round(F.stddev_samp("energy"), 6).alias("energy")).alias("std"))
    return flatten(nested)


def _frames(embeddings):
    e = F.col("embedding")
    at = lambda i: F.abs(e[i]).cast("double")
    return embeddings.select(
        F.col("label").alias("song_id"), F.col("vec_id").alias("frame"), at(12).alias("rms"), at(13).alias("zcr"), (at(14) * 3000).alias("centroid"), (at(15) * 4000).alias("bandwidth"), at(16).alias("flatness"), (at(17) * 20).alias("onset"),
        F.transform(F.slice(e, 1, 12), lambda x: F.abs(x).cast("double")).alias("chroma"))


@query("embeddings", """
WITH f AS (SELECT label AS song_id, abs(embedding[13])::DOUBLE AS rms, abs(embedding[14])::DOUBLE AS zcr, abs(embedding[15])::DOUBLE * 3000 AS centroid, abs(embedding[16])::DOUBLE * 4000 AS bandwidth, abs(embedding[17])::DOUBLE AS flatness, abs(embedding[18])::DOUBLE * 20 AS onset FROM embeddings)
SELECT song_id, count(*) AS frames, round(least(avg(rms) * 10, 1), 6) AS energy, round(avg(rms) * 60 - 60, 6) AS loudness, round(least(var_pop(onset) / 100 + 0.1, 1), 6) AS danceability, round(least(avg(zcr) * 5, 1), 6) AS speechiness,
  round(greatest(least(1 - avg(bandwidth) / 4000, 1), 0), 6) AS acousticness, round(least(greatest((max(rms) - min(rms)) * 40 + 30 + avg(rms) / (stddev_pop(rms) + 1e-8) * 30, 0), 100), 4) AS audio_appeal FROM f GROUP BY 1""")
def aud1_aud3_song_features(embeddings):
    found = audio.song_features(_frames(embeddings))
    return found.select("song_id", "frames", *[F.round(c, 6).alias(c) for c in ("energy", "loudness", "danceability", "speechiness", "acousticness")], F.round("audio_appeal", 4).alias("audio_appeal"))


@query("embeddings", """
WITH p AS (SELECT label AS song_id, i - 1 AS pitch, sum(abs(embedding[i])::DOUBLE) AS total FROM embeddings, range(1, 13) t(i) GROUP BY ALL)
SELECT song_id, CAST(arg_max(pitch, (total, -pitch)) AS INT) AS key, CAST(corr(total, [1,0,1,0,1,1,0,1,0,1,0,1][pitch + 1]) > corr(total, [1,0,1,1,0,1,0,1,1,0,1,0][pitch + 1]) AS INT) AS mode FROM p GROUP BY 1""")
def aud2_keys_and_modes(embeddings):
    return audio.keys_and_modes(_frames(embeddings))


@query("embeddings", "SELECT label AS song_id, 0.5::DOUBLE AS normalized_popularity, 'pop' AS genre_clean, 0 AS spotify, 0 AS tiktok, 0 AS youtube FROM embeddings GROUP BY 1")
def aud4_model_defaults(embeddings):
    return audio.with_model_defaults(embeddings.select(F.col("label").alias("song_id")).distinct())


@query("song_status", """
SELECT song_id, max(status_ts) AS status_ts, arg_max(seq, (status_ts, seq)) AS seq, arg_max(processing_status, (status_ts, seq)) AS status,
  CASE arg_max(processing_status, (status_ts, seq)) WHEN 'pending' THEN 10 WHEN 'processing' THEN 60 WHEN 'completed' THEN 100 ELSE 0 END AS progress FROM song_status GROUP BY 1""")
def st1_st2_latest_status(song_status):
    return status.latest_status(song_status)


@query("song_status", "SELECT song_id, arg_max(processing_status, (status_ts, seq)) AS processing_status FROM song_status GROUP BY 1")
def snk6_current_rows(song_status):
    return status.current(song_status, "song_id", ["status_ts", "seq"]).select("song_id", "processing_status")


@query("tracks", f"""
SELECT rec_id, trim(regexp_replace(regexp_replace(lower(artist_name), '^(the|a|an)\\s+', ''), '[^\\w\\s]', '', 'g')) AS artist_clean, regexp_matches(track_name, '{T.FEATURED}') AS has_featured FROM tracks""")
def ds12_normalized_names(tracks):
    return tracks.select("rec_id", T.clean_artist(F.col("artist_name")).alias("artist_clean"), (F.size(T.featured_artists(F.col("track_name"))["featured"]) > 0).alias("has_featured"))
