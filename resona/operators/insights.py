"""Rule-based texts and platform scores per song, as column expressions. A songs table goes in, one row per song comes out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.functions.numeric import best_of, ranked
from resona.operators.scores import AGE_PROFILES, PLATFORM_PROFILES, profile_fit

# Thresholds and texts, in order. A rule group gives its first match.
SOUND_RULES = (
    (("energy > 0.75", "high-energy"), ("energy < 0.35", "mellow")),
    (("valence > 0.7", "very upbeat"), ("valence > 0.5", "positive"), ("valence < 0.3", "melancholic")),
    (("danceability > 0.75", "highly danceable"), ("danceability > 0.5", "moderately danceable")),
    (("acousticness > 0.6", "acoustic"), ("acousticness < 0.2", "electronic")),
    (("instrumentalness < 0.1", "vocal-focused"),),
)
STRENGTH_RULES = (
    (("energy > 0.8", "exceptionally high energy"),),
    (("danceability > 0.85", "outstanding danceability"),),
    (("valence > 0.8", "extremely positive mood"),),
    (("audio_appeal > 85", "premium production quality"),),
)
ACTION_RULES = (
    (("danceability > 0.75", "Create dance/choreography content for social media"),),
    (("valence > 0.7", "Pitch to upbeat, feel-good, and motivational playlists"),),
    (("energy > 0.7", "Target fitness, workout, and high-energy playlist curators"),),
)
FOCUS_RULES = ((("danceability > 0.7", "dance"),), (("energy > 0.7", "energy"),), (("valence > 0.6", "mood"),), (("acousticness > 0.5", "acoustic"),))
GENRE_FIT = {
    "pop": {"spotify": 0.9, "tiktok": 0.8, "youtube": 0.8},
    "hip hop": {"spotify": 0.7, "tiktok": 1.0, "youtube": 0.7},
    "electronic": {"spotify": 0.8, "tiktok": 0.9, "youtube": 0.6},
    "rock": {"spotify": 0.8, "tiktok": 0.4, "youtube": 0.9},
    "country": {"spotify": 0.9, "tiktok": 0.5, "youtube": 0.8},
    "r&b": {"spotify": 0.9, "tiktok": 0.7, "youtube": 0.7},
    "indie": {"spotify": 0.9, "tiktok": 0.5, "youtube": 0.8},
}


def rule_texts(rules: Sequence[Sequence[tuple[str, str]]]) -> Column:
    """Array of the first matching text of each group, groups without a match left out."""
    def first(group):
        out = F
        for condition, text in group:
            out = out.when(F.expr(condition), F.lit(text))
        return out.otherwise(F.lit(None).cast("string"))

    return F.array_compact(F.array(*[first(g) for g in rules]))


def sound_profile(most: int = 4) -> Column:
    found = rule_texts(SOUND_RULES)
    return F.when(F.size(found) == 0, "balanced").otherwise(F.array_join(F.slice(found, 1, most), ", "))


def competitive_advantage(similarity: Column) -> Column:
    """Strengths by threshold; without any, a distinctive sound below a similarity of .8."""
    found = rule_texts(STRENGTH_RULES)
    return (
        F.when(similarity.isNull(), "Unique sound with no close comparisons")
        .when(F.size(found) > 0, F.concat(F.lit("Key strengths: "), F.array_join(found, ", ")))
        .when(similarity < 0.8, "Key strengths: distinctive sound profile")
        .otherwise("Well-balanced sound with broad appeal"))


# Texts for the short-video platform, in order; the number is the least probability.
TIKTOK_RULES = (
    ("danceability > 0.7", 0.7, "High viral potential - create dance challenges and trending content"),
    ("energy > 0.7", 0.5, "Good energy for fitness/workout content and energetic trends"),
    ("true", 0.3, "Moderate potential - focus on creative storytelling or niche trends"),
)


def tiktok_text(probability: Column) -> Column:
    out = F
    for condition, least, text in TIKTOK_RULES:
        out = out.when(F.expr(condition) & (probability > least), F.lit(text))
    return out.otherwise(F.lit("Limited TikTok appeal - consider other platforms first"))


def confidence_level(probability: Column) -> Column:
    return F.when(probability > 0.7, "high").when(probability > 0.4, "medium").otherwise("low")


def action_items(platform: Column, probability: Column, most: int = 8) -> Column:
    """The platform's priority first, then content actions; at most ``most``."""
    level = F.when(probability > 0.7, "HIGH").when(probability > 0.4, "MEDIUM").otherwise("LOW")
    return F.slice(F.concat(F.array(F.concat(level, F.lit(" PRIORITY: "), F.initcap(platform))), rule_texts(ACTION_RULES)), 1, most)


def platform_fits(fits: Mapping[str, Mapping[str, float]] = GENRE_FIT) -> dict[str, Column]:
    """Weighted feature fit of each platform, compatibility by genre, hook strength, mood appeal and tempo fit."""
    d, e, v, a, i, s, l, t = (F.col(c) for c in ("danceability", "energy", "valence", "acousticness", "instrumentalness", "speechiness", "liveness", "tempo"))
    quality = F.col("audio_appeal") / 100
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")

    def genre(platform: str) -> Column:
        out = F
        for name, values in fits.items():
            out = out.when(F.lower("genre") == name, F.lit(values[platform]))
        return out.otherwise(F.lit(0.7))

    return {
        "spotify_fit": v * 0.25 + e * 0.2 + a * 0.2 + (1 - i) * 0.2 + quality * 0.15,
        "tiktok_fit": d * 0.4 + e * 0.3 + yes(s > 0.1) * 0.15 + v * 0.15,
        "youtube_fit": e * 0.3 + (1 - i) * 0.25 + v * 0.2 + yes(l > 0.2) * 0.15 + quality * 0.1,
        **{f"genre_{p}_fit": genre(p) for p in ("spotify", "tiktok", "youtube")},
        "hook_strength": d * e * (1 - i),
        "mood_appeal": F.when(v > 0.6, v * e).otherwise(v * 0.5),
        "tempo_tiktok": F.when(t.between(100, 140), 1.0).otherwise(0.5),
    }


def viral_fits() -> dict[str, Column]:
    """The second preset: scores for virality, recommendation and engagement."""
    d, e, v, a, i, s, l = (F.col(c) for c in ("danceability", "energy", "valence", "acousticness", "instrumentalness", "speechiness", "liveness"))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "tiktok_viral_score": d * 0.35 + e * 0.25 + yes(s > 0.1) * 0.15 + yes(i < 0.5) * 0.25,
        "spotify_algorithm_score": v * 0.2 + e * 0.2 + a * 0.15 + (1 - i) * 0.25 + F.col("audio_appeal") / 100 * 0.2,
        "youtube_engagement_score": e * 0.3 + (1 - i) * 0.3 + v * 0.2 + yes(l > 0.2) * 0.2,
        "mood_blend": v * (1 - a) * e,
    }


def rescaled(platform: str, raw: Column) -> Column:
    """A model's raw score on the platform's scale, within 0-100."""
    return F.least(F.greatest(raw * {"tiktok": 20.0, "youtube": 0.8}.get(platform, 1.0), F.lit(0.0)), F.lit(100.0))


def basic_platforms() -> Column:
    """Array of struct(name, score) by three thresholds, best first; a default list when none holds."""
    entry = lambda n, s: F.struct(F.lit(n).alias("name"), F.lit(s).alias("score"))
    found = F.array_compact(F.array(F.when(F.col("danceability") > 0.7, entry("tiktok", 75)), F.when(F.col("valence") > 0.6, entry("spotify", 70)), F.when(F.col("energy") > 0.6, entry("youtube", 65))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(entry("spotify", 50), entry("tiktok", 45), entry("youtube", 40)))


def fallback_platforms() -> dict[str, Column]:
    """Linear platform scores for songs without model output; missing features count .5 (appeal 50)."""
    at = lambda c, d: F.coalesce(c, F.lit(d))
    d, e, v, i = (at(c, 0.5) for c in ("danceability", "energy", "valence", "instrumentalness"))
    most = lambda c: F.least(c, F.lit(100.0))
    return {"tiktok": most(d * 40 + e * 35 + v * 25), "spotify": most(v * 30 + e * 25 + at("audio_appeal", 50.0) * 0.45), "youtube": most(e * 35 + v * 30 + (1 - i) * 35)}


def song_insights(songs: DataFrame) -> DataFrame:
    """Full rule-only analysis of every song as one nested row: audience, platforms, texts, actions."""
    platforms = fallback_platforms()
    top = best_of(platforms)
    probability = F.array_max(F.array(*platforms.values())) / 100
    return songs.select(
        "rec_id",
        best_of({n: profile_fit(p) for n, p in AGE_PROFILES.items()}).alias("audience"),
        top.alias("top_platform"),
        ranked(platforms).alias("platforms"),
        best_of({n: profile_fit(p) for n, p in PLATFORM_PROFILES.items()}).alias("best_profile"),
        F.struct(sound_profile().alias("sound"), competitive_advantage(F.lit(1.0)).alias("advantage"), confidence_level(probability).alias("confidence"), action_items(top, probability).alias("actions"), rule_texts(FOCUS_RULES).alias("focus")).alias("insights"),
    )


def strategies(success: DataFrame) -> DataFrame:
    """(feature, advice) rows for the features whose mean over the successful songs is above .6."""
    row = success.agg(*[F.avg(c).alias(c) for c in ("energy", "danceability", "valence")])
    advice = {"energy": "lead with energetic cuts", "danceability": "seed dance clips", "valence": "place on upbeat lists"}
    rows = F.array_compact(F.array(*[F.when(F.col(c) > 0.6, F.struct(F.lit(c).alias("feature"), F.lit(t).alias("advice"))) for c, t in advice.items()]))
    return row.select(F.inline(rows))


def predicted_platforms(songs: DataFrame, affinity: DataFrame, columns: Sequence[str], key: str = "rec_id") -> DataFrame:
    """Per song and platform the correlation-weighted sum of its features, and the rank; ``affinity`` has platform, feature, r.

    A song's rows are summed first: one row per song is shuffled, and its features and platforms stay where it is.
    """
    from pyspark.sql import Window

    sums = songs.groupBy(key).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in columns])
    long = sums.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])))
    total = long.join(F.broadcast(affinity.select("platform", "feature", "r")), "feature").groupBy(key, "platform").agg(F.sum(F.col("value") * F.col("r")).alias("score"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "platform")))


# Advice by platform.
PLATFORM_ADVICE = {
    "tiktok": ("Focus on 15-30 second hooks", "Create dance/challenge content", "Partner with Gen Z influencers", "Use trending sounds and hashtags", "Optimize for mobile-first viewing"),
    "spotify": ("Target playlist curators", "Focus on full-song experience", "Optimize for algorithm discovery", "Create artist playlists", "Leverage Spotify Canvas features"),
    "youtube": ("Create engaging music videos", "Optimize video thumbnails", "Focus on storytelling", "Leverage YouTube Shorts", "Collaborate with music reactors"),
}


def platform_strategies(affinity: DataFrame) -> DataFrame:
    """Per platform of ``affinity`` (platform, feature, r): the features whose correlation exceeds .3 either way, with their importance, and the platform's advice."""
    strong = F.struct("feature", "r", F.when(F.abs("r") > 0.5, "high").otherwise("moderate").alias("importance"))
    advice = F.create_map(*[x for p, lines in PLATFORM_ADVICE.items() for x in (F.lit(p), F.array(*[F.lit(t) for t in lines]))])
    found = affinity.groupBy("platform").agg(F.array_sort(F.collect_list(F.when(F.abs("r") > 0.3, strong))).alias("primary_features"))
    return found.withColumn("strategies", F.coalesce(advice[F.col("platform")], F.expr("CAST(array() AS array<string>)")))


# Strategies, platforms and content by the audience that a profile's name begins with.
AUDIENCE_STRATEGIES = {
    "Gen Z": (("TikTok-first content strategy", "Short-form video content", "Trend-driven campaigns", "Authentic, unpolished aesthetics", "Social cause alignment"),
              ("TikTok", "Instagram Reels", "YouTube Shorts"), ("Dance challenges", "Memes", "Behind-the-scenes", "Collaborations")),
    "Millennials": (("Nostalgic content themes", "High-quality production", "Playlist-focused marketing", "Festival and live event tie-ins", "Email marketing campaigns"),
                    ("Spotify", "Facebook", "Instagram", "YouTube"), ("Music videos", "Acoustic sessions", "Interviews", "Live performances")),
    "Cross-Platform": (("Integrated multi-platform campaigns", "Consistent branding across platforms", "Platform-specific content adaptations", "Community building approach", "Data-driven optimization"),
                       ("All major platforms",), ("Adapted content for each platform", "Cross-platform storytelling")),
}


def audience_strategies(songs: DataFrame, alignments: Mapping[str, Column]) -> DataFrame:
    """Per audience of the strategy table that some alignment's name holds: the mean alignment over all songs and the audience's strategies, platforms and content."""
    row = songs.agg(*[F.avg(c).alias(n) for n, c in alignments.items()])
    listed = lambda texts: F.array(*[F.lit(t) for t in texts])
    found = {next((a for a in AUDIENCE_STRATEGIES if a in n), None): n for n in alignments}
    entries = [F.struct(F.lit(a).alias("audience"), F.col(f"`{found[a]}`").alias("avg_alignment"), *[listed(t).alias(k) for k, t in zip(("strategies", "platforms", "content"), AUDIENCE_STRATEGIES[a], strict=True)]) for a in AUDIENCE_STRATEGIES if a in found]
    return row.select(F.inline(F.array(*entries)))


# Texts by platform; (feature, above, probability above, text) in order, then the last resort.
PLATFORM_TEXTS = {
    "tiktok": ((("danceability", 0.7, 0.7, "High viral potential - create dance challenges and trending content"), ("energy", 0.7, 0.5, "Good energy for fitness/workout content and energetic trends"),
                (None, None, 0.3, "Moderate potential - focus on creative storytelling or niche trends")), "Limited TikTok appeal - consider other platforms first"),
    "spotify": ((("valence", 0.6, 0.7, "Excellent for mood-based and feel-good playlists"), ("acousticness", 0.5, 0.5, "Strong fit for acoustic, chill, and indie playlists"),
                 (None, None, 0.4, "Good playlist potential - target genre-specific and algorithmic playlists")), "Consider playlist pitching and acoustic versions"),
    "youtube": ((("energy", 0.6, 0.7, "High potential for engaging music videos and visual content"), ("liveness", 0.3, 0.5, "Great for live performance videos and session content"),
                 (None, None, 0.4, "Good for lyric videos and storytelling content")), "Focus on other platforms or try creative video concepts"),
}


def platform_text(platform: str, probability: Column) -> Column:
    """What a song's features and its chance of success on the platform suggest."""
    rules, last = PLATFORM_TEXTS[platform]
    out = F
    for feature, above, likely, text in rules:
        out = out.when((probability > likely) & (F.col(feature) > above if feature else F.lit(True)), F.lit(text))
    return out.otherwise(F.lit(last))


def group_strategies(profiles: DataFrame, shares: DataFrame, key: str) -> DataFrame:
    """Per group: audiences and content advice by its labels (of ``profiles``), and its three largest platforms (of ``shares``: key, platform, percentage) with their priority."""
    from pyspark.sql import Window

    text = lambda *names: F.array(*[F.lit(n) for n in names])
    none = F.expr("CAST(array() AS array<string>)")
    has = lambda label: F.array_contains("labels", label)
    lively, acoustic = has("danceable") & has("high energy"), has("acoustic")
    audiences = F.when(lively, text("Gen Z (16-24)", "Millennials (25-40)")).when(acoustic, text("Gen X (41-56)", "Boomers (57+)")).otherwise(none)
    content = F.when(lively, text("Focus on dance challenges and high-energy content")).when(acoustic, text("Emphasize intimate, authentic performances")).otherwise(none)
    placed = shares.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("percentage"), "platform"))).where("place <= 3")
    entry = F.struct("place", "platform", "percentage", F.when(F.col("percentage") > 30, "High").otherwise("Medium").alias("priority"))
    listed = placed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["platform"].alias("platform"), x["percentage"].alias("percentage"), x["priority"].alias("priority"))).alias("platforms"))
    return profiles.join(listed, key, "left").select(key, audiences.alias("audiences"), content.alias("content"), "platforms")
