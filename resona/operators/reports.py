"""Composed reports as long tables (section, place, item, measure, value, text), and their JSON and text forms.

A report holds totals, top lists and a row per source or feature, so it stays small however large its tables are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resona.operators import scores, tables

# Bounds, priorities and texts of the recommendations.
RECOMMENDATIONS = {
    "Data Quality": (70, "High", "Overall data quality is below 70%. Consider improving data collection processes."),
    "Data Completeness": (80, "Medium", "{} is only {}% complete. Consider additional data sources or imputation strategies."),
    "Data Consistency": (10, "Medium", "Found {} songs with inconsistent popularity across platforms. Review normalization methods."),
    "Genre Mapping": (50, "Low", "{} songs have inconsistent genre assignments. Consider genre standardization."),
}


def _long(df: DataFrame, section: str, place: Column, item: Column, values: Sequence[str], texts: Sequence[str] = (), digits: int = 4) -> DataFrame:
    entry = lambda name, value, text: F.struct(F.lit(name).alias("measure"), value.cast("double").alias("value"), text.cast("string").alias("text"))
    entries = [entry(v, F.round(F.col(v).cast("double"), digits), F.lit(None)) for v in values] + [entry(t, F.lit(None), F.col(t)) for t in texts]
    return df.select(F.lit(section).alias("section"), place.cast("int").alias("place"), item.cast("string").alias("item"), F.inline(F.array(*entries)))


def _placed(df: DataFrame, order: Sequence[Column | str], top: int) -> DataFrame:
    """The first ``top`` rows with their place; only they are numbered."""
    return df.orderBy(*order).limit(top).withColumn("_place", F.row_number().over(Window.orderBy(*order)))


def ar_sections(scored: DataFrame, key: str = "rec_id", top: int = 20) -> DataFrame:
    """The talent report: summary, promising artists, top tracks and genres by opportunity, of songs with their scores (``scores.with_ar_scores``)."""
    scored = tables.settled(scored)
    artists = tables.settled(_placed(scores.promising_artists(scored, top=top), [F.desc("avg_ar_score"), F.col("artist_name")], top))
    totals = scored.agg(
        F.count("*").alias("dataset_size"), F.countDistinct("artist_name").alias("unique_artists"), F.round(F.avg("ar_score"), 2).alias("avg_ar_score"), F.count_if(F.col("ar_score") >= 70).alias("high_potential_tracks"))
    summary = totals.crossJoin(F.broadcast(artists.agg(F.count_if(F.col("avg_ar_score") >= 60).alias("promising_artists_count"))))
    tracks = _placed(scored, [F.desc("ar_score"), F.col(key)], top)
    genres = _placed(scores.genre_opportunities(scored), [F.desc("opportunity_score"), F.col("genre")], top)
    place = F.col("_place")
    return tables.union_all(
        _long(summary, "summary", F.lit(1), F.lit("all"), ["dataset_size", "unique_artists", "avg_ar_score", "high_potential_tracks", "promising_artists_count"]),
        _long(artists, "promising_artists", place, F.col("artist_name"), ["track_count", "avg_ar_score", "max_ar_score", "consistency"], ["category"]),
        _long(tracks, "top_tracks", place, F.col(key), ["ar_score", *scores.AR_WEIGHTS, "normalized_popularity"], ["track_name", "artist_name", "genre"]),
        _long(genres, "market_opportunities", place, F.col("genre"), ["track_count", "market_saturation", "opportunity_score"]),
    )


def recommendations(completeness: DataFrame, facts: DataFrame) -> DataFrame:
    """(category, priority, recommendation) of ``completeness`` (feature, percent) and the one row ``facts`` (overall, popularity_outliers, mixed_genres)."""
    low, priority, text = RECOMMENDATIONS["Data Completeness"]
    thin = completeness.where(F.col("percent") < low).select(F.lit("Data Completeness").alias("category"), F.lit(priority).alias("priority"), _filled(text, F.col("feature"), F.col("percent")).alias("recommendation"))
    checks = {"Data Quality": ("overall", lambda c, x: c < x), "Data Consistency": ("popularity_outliers", lambda c, x: c > x), "Genre Mapping": ("mixed_genres", lambda c, x: c > x)}
    rows = []
    for category, (column, fails) in checks.items():
        bound, priority, text = RECOMMENDATIONS[category]
        found = F.struct(F.lit(category).alias("category"), F.lit(priority).alias("priority"), _filled(text, F.col(column)).alias("recommendation"))
        rows.append(F.when(fails(F.col(column), bound), found))
    return thin.union(facts.select(F.inline(F.array_compact(F.array(*rows)))))


def _filled(text: str, *values: Column) -> Column:
    parts = text.split("{}")
    pairs = [x for part, value in zip(parts, values, strict=False) for x in (F.lit(part), value.cast("string"))]
    return F.concat(*pairs, F.lit(parts[-1])) if len(parts) > 1 else F.lit(text)


def integration_sections(masters: DataFrame, raw: DataFrame, overall: DataFrame, features: Sequence[str], apart: float = 30) -> DataFrame:
    """The integration report: summary, completeness by feature, sources and recommendations.

    ``masters`` has one row per song with primary_source, source_count and both popularities, ``raw`` the rows of all sources with
    source_dataset and source_priority, ``overall`` one row with the quality score. A song's genres are mixed when its raw rows name several.
    """
    # read twice: only what is read of a master is kept
    masters = tables.settled(masters.select("primary_source", "source_count", "avg_popularity", "normalized_popularity", *features))
    percent = lambda c: F.round(F.count(c) / F.count("*") * 100, 2).alias(c)
    row = masters.agg(
        F.count("*").alias("total_unique_tracks"), F.count_if(F.col("source_count") > 1).alias("multi_source_tracks"), F.count_if(F.abs(F.col("avg_popularity") - F.col("normalized_popularity")) > apart).alias("popularity_outliers"),
        *[percent(c) for c in features])
    named = raw.where("genre IS NOT NULL AND genre <> 'unknown'").groupBy("track_name", "artist_name").agg((F.min("genre") != F.max("genre")).alias("mixed"))
    facts = tables.settled(row.crossJoin(F.broadcast(named.agg(F.count_if("mixed").alias("mixed_genres")))).crossJoin(F.broadcast(overall.select(F.round("overall", 2).alias("overall")))))
    own = masters.groupBy(F.col("primary_source").alias("source_dataset")).agg(F.count("*").alias("contribution_to_master"))
    sources = raw.groupBy("source_dataset").agg(F.count("*").alias("total_records"), F.min("source_priority").alias("priority"), *[percent(c) for c in features])
    sources = tables.settled(sources.join(own, "source_dataset", "left").na.fill(0, ["contribution_to_master"]))
    complete = facts.unpivot([], list(features), "feature", "percent")
    summary = facts.crossJoin(F.broadcast(sources.agg(F.count("*").alias("source_datasets"))))
    advice = recommendations(complete, facts)
    return tables.union_all(
        _long(summary, "executive_summary", F.lit(1), F.lit("all"), ["total_unique_tracks", "source_datasets", "multi_source_tracks", "overall"]),
        _long(complete, "data_completeness", F.lit(1), F.col("feature"), ["percent"]),
        _long(sources, "data_sources", F.col("priority"), F.col("source_dataset"), ["total_records", "contribution_to_master", *features]),
        _long(advice, "recommendations", F.lit(1), F.col("category"), [], ["priority", "recommendation"]),
    )


def as_document(sections: DataFrame) -> DataFrame:
    """One row whose ``report`` maps a section to its items, by place, then name, for ``sinks.json_report``."""
    measure = F.struct("measure", F.coalesce(F.col("text"), F.col("value").cast("string")).alias("value"))
    items = sections.groupBy("section", "place", "item").agg(F.array_sort(F.collect_list(measure)).alias("measures"))
    parts = items.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("place", "item", "measures"))).alias("items"))
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("section", "items"))).alias("parts"))
    named = lambda i: F.struct(i["item"].alias("item"), F.map_from_entries(i["measures"]).alias("measures"))  # noqa: E731  (maps can't be sorted, so they come last)
    return whole.select(F.map_from_entries(F.transform("parts", lambda p: F.struct(p["section"].alias("section"), F.transform(p["items"], named).alias("items")))).alias("report"))


def as_lines(sections: DataFrame, title: str) -> DataFrame:
    """(section, ord, line) for ``sinks.text_report``: the title underlined, then per section its name underlined and one line per item."""
    head = sections.sparkSession.createDataFrame([("", 0, title), ("", 1, "=" * len(title))], "section string, ord int, line string")
    shown = F.concat(F.col("measure"), F.lit(": "), F.coalesce(F.col("text"), F.format_number("value", 2), F.lit("unknown")))
    items = sections.groupBy("section", "place", "item").agg(F.array_join(F.array_sort(F.collect_list(shown)), ", ").alias("all"))
    ordered = items.withColumn("ord", F.row_number().over(Window.partitionBy("section").orderBy("place", "item", "all")) + 2)
    body = ordered.select("section", "ord", F.concat(F.lit("  "), "item", F.lit(" - "), "all").alias("line"))
    names = sections.select("section").distinct()
    heads = names.select("section", F.inline(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("").alias("line")), F.struct(F.lit(1).alias("ord"), F.initcap(F.replace("section", F.lit("_"), F.lit(" "))).alias("line")),
        F.struct(F.lit(2).alias("ord"), F.repeat(F.lit("-"), F.length("section")).alias("line")))))
    return head.union(heads).union(body)
