"""Row-level scores as column expressions. Presets are plain tables of numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.functions.numeric import clip, cut_bins, min_max, row_mean
from resona.operators.quantiles import quantile_row

# Ideal features, scales and weights of the profiles.
AGE_PROFILES = {
    "Gen Z (16-24)": {"danceability": 0.8, "energy": 0.75, "valence": 0.7, "speechiness": 0.3, "acousticness": 0.2, "tempo": 120},
    "Millennials (25-40)": {"danceability": 0.65, "energy": 0.6, "valence": 0.6, "speechiness": 0.15, "acousticness": 0.4, "tempo": 110},
    "Gen X (41-56)": {"danceability": 0.5, "energy": 0.55, "valence": 0.5, "speechiness": 0.1, "acousticness": 0.6, "tempo": 100},
    "Boomers (57+)": {"danceability": 0.4, "energy": 0.4, "valence": 0.45, "speechiness": 0.05, "acousticness": 0.7, "tempo": 90},
}
PLATFORM_PROFILES = {
    "TikTok": {"danceability": 0.8, "energy": 0.85, "valence": 0.75, "speechiness": 0.4, "tempo": 130, "weight": 1.2},
    "Instagram": {"danceability": 0.7, "energy": 0.7, "valence": 0.65, "acousticness": 0.3, "tempo": 115, "weight": 1.0},
    "Spotify": {"danceability": 0.6, "energy": 0.6, "valence": 0.55, "acousticness": 0.5, "instrumentalness": 0.2, "weight": 1.1},
    "YouTube": {"danceability": 0.55, "energy": 0.65, "valence": 0.6, "acousticness": 0.4, "liveness": 0.3, "weight": 0.9},
}
TREND_PROFILES = {
    "viral_potential": {"danceability": 0.75, "energy": 0.8, "valence": 0.7, "speechiness": 0.25, "tempo": 125, "weight": 1.3},
    "playlist_friendly": {"danceability": 0.65, "energy": 0.6, "valence": 0.6, "acousticness": 0.3, "instrumentalness": 0.1, "weight": 1.1},
    "social_media_ready": {"danceability": 0.8, "energy": 0.85, "speechiness": 0.35, "tempo": 130, "valence": 0.75, "weight": 1.2},
}
RANGE_PROFILES = {
    "Gen Z (TikTok-focused)": {"danceability": (0.6, 1.0), "energy": (0.5, 1.0), "valence": (0.4, 1.0), "tempo": (100, 180)},
    "Millennials (Spotify-focused)": {"danceability": (0.3, 0.8), "energy": (0.3, 0.8), "acousticness": (0.0, 0.6), "valence": (0.2, 0.8)},
    "Cross-Platform Appeal": {"danceability": (0.5, 0.8), "energy": (0.4, 0.8), "valence": (0.4, 0.8), "speechiness": (0.0, 0.3)},
}
GENRE_TRENDS = {
    "pop": (1.2, {"danceability": 0.7, "energy": 0.6, "valence": 0.6}),
    "hip hop": (1.1, {"danceability": 0.8, "speechiness": 0.4, "energy": 0.7}),
    "electronic": (1.1, {"danceability": 0.8, "energy": 0.9, "acousticness": 0.1}),
    "rock": (0.9, {"energy": 0.8, "acousticness": 0.3, "loudness": -5}),
    "acoustic": (0.8, {"acousticness": 0.8, "energy": 0.3, "valence": 0.5}),
}
AR_WEIGHTS = {"commercial_potential": 0.35, "musical_quality": 0.25, "market_fit": 0.20, "uniqueness": 0.15, "scalability": 0.05}
QUALITY_FEATURES = ("danceability", "energy", "valence", "acousticness", "instrumentalness")
UNIQUE_FEATURES = (*QUALITY_FEATURES, "speechiness")
PLATFORMS = ("spotify", "tiktok", "youtube")


def platform_count(flags: Sequence[str] = PLATFORMS) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags])


def profile_fit(profile: Mapping[str, float], tempo_scale: float = 100.0, digits: int = 2) -> Column:
    """0-100 times the weight: mean closeness to the ideals over the features that are there; 0 with none."""
    def near(feature: str, ideal: float) -> Column:
        gap = F.abs(F.col(feature) - F.lit(float(ideal)))
        return F.when(F.col(feature).isNotNull(), F.greatest(F.lit(0.0), 1 - (gap / tempo_scale if feature == "tempo" else gap)))

    ideals = {f: ideal for f, ideal in profile.items() if f != "weight"}
    mean = row_mean(*[near(f, ideal) for f, ideal in ideals.items()], of=[F.col(f) for f in ideals])
    return F.round(F.coalesce(mean * float(profile.get("weight", 1.0)) * 100, F.lit(0.0)), digits)


def range_alignment(ranges: Mapping[str, tuple[float, float]]) -> Column:
    """Mean over present features of 1 inside the range, else 1 minus the distance from it, 0 at least."""
    def fit(feature: str, low: float, high: float) -> Column:
        distance = F.greatest(F.lit(float(low)) - F.col(feature), F.col(feature) - F.lit(float(high)), F.lit(0.0))
        return F.when(F.col(feature).isNotNull(), F.greatest(F.lit(0.0), 1 - distance))

    return F.coalesce(row_mean(*[fit(f, lo, hi) for f, (lo, hi) in ranges.items()], of=[F.col(f) for f in ranges]), F.lit(0.0))


def data_quality() -> Column:
    """0-100: completeness 40, popularity 20, known genre 15, platforms up to 15, several sources 10."""
    share = reduce(lambda a, b: a + b, [F.col(f).isNotNull().cast("int") for f in QUALITY_FEATURES]) / len(QUALITY_FEATURES)
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return F.round(
        share * 40 + F.col("normalized_popularity").isNotNull().cast("int") * 20 + yes(F.col("genre") != "unknown") * 15
        + F.least(platform_count() * 5, F.lit(15)) + yes(F.col("source_count") > 1) * 10, 1)


def commercial_potential() -> Column:
    popularity = F.coalesce(F.least(F.col("normalized_popularity") / 100, F.lit(1.0)), F.lit(0.0))
    appeal = F.coalesce(row_mean(F.col("danceability"), F.col("energy"), F.col("valence")), F.lit(0.0))
    return F.least((popularity * 0.4 + F.least(platform_count() / 3, F.lit(1.0)) * 0.3 + appeal * 0.3) * 100, F.lit(100.0))


def musical_quality() -> Column:
    loud = F.col("loudness")
    production = F.when(loud.isNull(), 0.5).when(loud.between(-14, -6), 1.0).when(loud.between(-20, -14) | loud.between(-6, 0), 0.7).otherwise(0.4)
    mean = row_mean(F.col("acousticness"), F.col("instrumentalness"), F.col("speechiness"))
    complexity = F.when(mean.isNull(), 0.5).when(mean.between(0.2, 0.6), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(mean - 0.4) * 2))
    quality = F.coalesce(F.col("data_quality_score") / 100, F.lit(0.5))
    return F.least((production * 0.5 + complexity * 0.25 + quality * 0.25) * 100, F.lit(100.0))


def market_fit(trends: Mapping[str, tuple[float, Mapping[str, float]]] = GENRE_TRENDS) -> Column:
    genre = F.lower(F.coalesce("genre", F.lit("unknown")))
    base, weight = F, F
    for name, (w, features) in trends.items():
        near = [F.when(F.col(f).isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(F.col(f) - float(v)) / (20 if f == "loudness" else 1))) for f, v in features.items()]
        base = base.when(genre == name, F.coalesce(row_mean(*near, of=[F.col(f) for f in features]), F.lit(0.5)))
        weight = weight.when(genre == name, F.lit(w))
    bonus = F.when(genre.isin("pop", "hip hop", "electronic"), 0.1).otherwise(0.0)
    return F.least((base.otherwise(F.lit(0.5)) * weight.otherwise(F.lit(1.0)) + bonus) * 100, F.lit(100.0))


def with_uniqueness(df: DataFrame, features: Sequence[str] = UNIQUE_FEATURES) -> DataFrame:
    """Adds ``uniqueness``: bands of the distance from the global medians, which come as one broadcast row."""
    medians = quantile_row(df, features, (0.5,)).select(*[F.col(f)[0].alias(f"_m_{f}") for f in features])

    def band(f: str) -> Column:
        d = F.abs(F.col(f) - F.col(f"_m_{f}"))
        return F.when(d.isNull(), F.lit(None).cast("double")).when(d.between(0.1, 0.3), 1.0).when(d.between(0.05, 0.1) | d.between(0.3, 0.4), 0.8).when(d <= 0.05, 0.3).otherwise(0.5)

    scored = df.crossJoin(F.broadcast(medians)).withColumn("uniqueness", F.coalesce(row_mean(*[band(f) for f in features], of=[F.col(f) for f in features]) * 100, F.lit(50.0)))
    return scored.drop(*[f"_m_{f}" for f in features])


def scalability() -> Column:
    return (F.least(F.col("source_count") / 5, F.lit(1.0)) * 0.5 + platform_count() / 3 * 0.4 + F.coalesce("data_quality_score", F.lit(0.0)) / 100 * 0.1) * 100


def with_ar_scores(df: DataFrame, digits: int = 2) -> DataFrame:
    """Adds data quality, the five component scores and ``ar_score``."""
    scored = with_uniqueness(df.withColumn("data_quality_score", data_quality())).withColumns(
        {"commercial_potential": commercial_potential(), "musical_quality": musical_quality(), "market_fit": market_fit(), "scalability": scalability()})
    return scored.withColumn("ar_score", F.round(reduce(lambda a, b: a + b, [F.col(c) * w for c, w in AR_WEIGHTS.items()]), digits))


def promising_artists(scored: DataFrame, min_tracks: int = 2, top: int = 20) -> DataFrame:
    """Artists by mean score with consistency, spread over platforms, best track and a category."""
    out = scored.groupBy("artist_name").agg(
        F.count("*").alias("track_count"), F.avg("ar_score").alias("avg_ar_score"), F.max("ar_score").alias("max_ar_score"),
        (100 - F.stddev_samp("ar_score")).alias("consistency"), F.avg("normalized_popularity").alias("avg_popularity"),
        F.sum(platform_count()).alias("platform_diversity"), F.mode("genre", True).alias("genre_focus"), F.sum("source_count").alias("total_sources"),
        F.max_by("track_name", F.struct("ar_score", "track_name")).alias("best_track"),
    ).where(F.col("track_count") >= min_tracks)
    category = (
        F.when(F.col("avg_ar_score") >= 75, F.when(F.col("avg_popularity") >= 70, "Established Hit-Maker").otherwise("High Potential Emerging"))
        .when(F.col("avg_ar_score") >= 60, F.when(F.col("consistency") >= 80, "Consistent Performer").otherwise("Variable Quality"))
        .when(F.col("max_ar_score") >= 80, "One Hit Wonder Potential")
        .otherwise("Development Needed"))
    return out.withColumn("category", category).orderBy(F.desc("avg_ar_score"), "artist_name").limit(top)


def genre_opportunities(scored: DataFrame, min_tracks: int = 10) -> DataFrame:
    """Per known genre: saturation, bands of quality, and the opportunity score."""
    trend = F
    for name, (w, _) in GENRE_TRENDS.items():
        trend = trend.when(F.lower("genre") == name, F.lit(w))
    total = scored.agg(F.count("*").alias("total"))
    grouped = scored.where("genre <> 'unknown'").groupBy("genre").agg(
        F.count("*").alias("track_count"), F.avg("ar_score").alias("avg_ar_score"), F.avg("normalized_popularity").alias("avg_popularity"),
        F.count_if(F.col("ar_score") >= 70).alias("high_quality"), F.count_if((F.col("ar_score") >= 50) & (F.col("ar_score") < 70)).alias("medium_quality"), F.count_if(F.col("ar_score") < 50).alias("low_quality"))
    out = grouped.where(F.col("track_count") >= min_tracks).crossJoin(F.broadcast(total)).withColumn("market_saturation", F.col("track_count") / F.col("total") * 100).drop("total").withColumn("trend_alignment", trend.otherwise(F.lit(1.0)))
    score = (100 - F.col("market_saturation")) * 0.4 + F.col("avg_ar_score") * 0.3 + (F.col("trend_alignment") - 0.5) * 100 * 0.3
    return out.withColumn("opportunity_score", F.greatest(F.lit(0.0), score))


def virality(df: DataFrame, keys: Sequence[str] = ("track_clean", "artist_clean")) -> DataFrame:
    """Per song: peak, mean and number of listings combined, with a tier and the sorted platforms."""
    grouped = df.groupBy(*keys).agg(
        F.avg("popularity_score").alias("popularity_mean"), F.max("popularity_score").alias("popularity_max"), F.count("popularity_score").alias("platform_count"),
        F.sort_array(F.collect_set("platform")).alias("platforms"))
    score = (F.col("popularity_max") / 100 * 0.4 + F.col("popularity_mean") / 100 * 0.3 + F.col("platform_count") / 3 * 0.3) * 100
    tier = cut_bins(F.col("virality_score"), [0, 20, 40, 60, 80, 100], ["Low", "Medium-Low", "Medium", "Medium-High", "High"])
    return grouped.withColumn("virality_score", score).withColumn("virality_tier", tier)


def linear_alignment() -> dict[str, Column]:
    """Alignment by weighted sums for the two audiences, and by closeness to the middle for all platforms."""
    e, d, v, a, i = (F.col(c) for c in ("energy", "danceability", "valence", "acousticness", "instrumentalness"))
    middle = reduce(lambda x, y: x + y, [1 - F.abs(c - 0.5) * 2 for c in (e, d, v, a)]) / 4
    return {"gen_z": e * 0.4 + d * 0.4 + v * 0.2, "millennials": a * 0.3 + e * 0.3 + v * 0.2 + (1 - i) * 0.2, "cross_platform": middle}


def with_fallback_virality(df: DataFrame, popularity: str = "popularity_score") -> DataFrame:
    """Adds virality_score in 0-1: the popularity if the table has it, else the mean of three features, scaled by its range."""
    raw = F.col(popularity).cast("double") if popularity in df.columns else row_mean(F.col("energy"), F.col("danceability"), F.col("valence"))
    row = df.agg(F.min(raw).alias("_lo"), F.max(raw).alias("_hi"))
    return df.crossJoin(F.broadcast(row)).withColumn("virality_score", min_max(raw, F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def audio_appeal() -> Column:
    return (F.col("energy") * 0.3 + F.col("valence") * 0.3 + F.col("danceability") * 0.4) * 100


def growth_potential(quality: Column, popularity: Column, platforms: Column) -> Column:
    return (F.greatest(F.lit(0.0), quality - popularity) / 100 * 0.7 + platforms / 3 * 0.3) * 100


def growth_potential_linear(quality: Column, popularity: Column, platforms: Column) -> Column:
    return clip((quality - popularity) * 0.7 + platforms * 10, 0, 100)


def popular_enough(score: Column, platform: Column, thresholds: Mapping[str, float]) -> Column:
    """1 where the score is above its platform's threshold."""
    out = F
    for name, least in thresholds.items():
        out = out.when(platform == name, score > least)
    return F.coalesce(out.otherwise(F.lit(False)), F.lit(False)).cast("int")


def rule_labels(rules: Mapping[str, Sequence[tuple[str, float]]], base: float = 0.0) -> dict[str, Column]:
    """Weak labels per platform: base plus the bonus of every condition (SQL text) that holds, within 0-100."""
    total = lambda conditions: reduce(lambda a, b: a + b, [F.when(F.expr(c), F.lit(float(bonus))).otherwise(0.0) for c, bonus in conditions], F.lit(float(base)))
    return {name: F.least(F.greatest(total(conditions), F.lit(0.0)), F.lit(100.0)) for name, conditions in rules.items()}


def scaled(column: str, low: float, high: float) -> Column:
    return clip(min_max(F.col(column), low, high), 0, 1)
