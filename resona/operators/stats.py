"""Aggregates, profiles and validation figures. Each is one pass over the rows plus a small result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resona.operators.quantiles import quantiles
from resona.operators.tables import settled, top_per_group, unpivot


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def mode_of(column: str) -> Column:
    """The most frequent value; the smallest of equals."""
    return F.mode(column, True)


def best_row(columns: Sequence[str], score: str, tie: str) -> Column:
    """struct of the row with the largest score, the smallest tie key among equals."""
    return F.max_by(F.struct(*columns), F.struct(F.col(score), F.col(tie)))


def frequent_values(df: DataFrame, group: str, column: str) -> DataFrame:
    """Per group the distinct values, most frequent first."""
    counted = df.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), F.col(column).alias("v"))))
    return counted.groupBy(group).agg(F.transform(ordered, lambda x: x["v"]).alias("values"))


def pivot_mean(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], measure: str) -> DataFrame:
    return df.groupBy(*keys).pivot(column, list(values)).agg(F.avg(measure)).na.fill(0.0, list(values))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: count, mean, std, min, quartiles, max, skewness, excess kurtosis, missing. The quartiles come by selection, a row per column."""
    quarters = quantiles(df, columns, (0.25, 0.5, 0.75)).select("feature", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))])
    moments = unpivot(df, [], columns).groupBy("feature").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.skewness("value").alias("skew"),
        F.kurtosis("value").alias("kurt"),
        F.count_if(F.col("value").isNull()).alias("missing"),
    )
    return moments.join(F.broadcast(quarters), "feature", "left").select("feature", "n", "mean", "std", "least", "p25", "p50", "p75", "most", "skew", "kurt", "missing")


def correlations(df: DataFrame, group: Sequence[str], features: Sequence[str], target: str, least: int = 10) -> DataFrame:
    """Pearson correlation of each feature with the target per group, from more than ``least`` pairs."""
    pairs = unpivot(df, [*group, target], features).where(F.col("value").isNotNull() & F.col(target).isNotNull())
    return pairs.groupBy(*group, "feature").agg(F.corr("value", target).alias("r"), F.count("*").alias("n")).where(F.col("n") > least).where(F.col("r").isNotNull() & ~F.isnan("r"))


def top_correlations(found: DataFrame, group: Sequence[str], k: int = 3) -> DataFrame:
    signed = found.where("r <> 0").withColumn("sign", F.when(F.col("r") > 0, "positive").otherwise("negative"))
    return top_per_group(signed, [*group, "sign"], [F.desc(F.abs("r")), F.col("feature")], k)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for every pair of columns, over the rows where both are there; one aggregate."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, n) over equal widths; the last bin holds the largest value."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    place = F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    place = F.when(F.col("hi") > F.col("lo"), place).otherwise(0)
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def year_over_year(df: DataFrame, year: str, features: Sequence[str]) -> DataFrame:
    """First and last year's mean per feature, the change, its percentage and direction."""
    means = unpivot(df, [year], features).groupBy("feature", year).agg(F.avg("value").alias("mean"))
    out = means.groupBy("feature").agg(F.min_by("mean", year).alias("before"), F.max_by("mean", year).alias("after"))
    change = F.col("after") - F.col("before")
    return out.select("feature", "before", "after", change.alias("change"), F.when(F.col("before") != 0, change / F.col("before") * 100).alias("percent"),
                      F.when(change > 0, "increase").when(change < 0, "decrease").otherwise("stable").alias("direction"))


def share_of_total(df: DataFrame, group: str) -> DataFrame:
    """Group rows as a percentage of all rows."""
    counted = df.groupBy(group).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(group, "n", (F.col("n") / F.col("total") * 100).alias("share"))


def percent_rank_nonzero(df: DataFrame, key: str, column: str) -> DataFrame:
    """Average-tie percentile of the values above zero; 0 for the rest.

    Ranks come from a count per distinct value: windows run over the values of
    fixed ranges first and over the ranges' totals after, never over all rows in one task.
    """
    valued = df.where(F.col(column) > 0)
    counts = valued.groupBy(column).agg(F.count("*").alias("n"))
    ranged = settled(counts.repartitionByRange(column).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("n").alias("size"), F.min(column).alias("low"))
    before = totals.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("size").over(Window.partitionBy()))
    run = Window.partitionBy("part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranged.withColumn("here", F.coalesce(F.sum("n").over(run), F.lit(0))).join(F.broadcast(before.select("part", "before", "all")), "part")
    ranks = ranks.select(F.col(column).alias("_v"), ((F.col("before") + F.col("here") + (F.col("n") + 1) / 2) / F.col("all") * 100).alias("percentile"))
    return df.join(ranks, F.when(F.col(column) > 0, F.col(column)) == F.col("_v"), "left").select(key, F.coalesce("percentile", F.lit(0.0)).alias("percentile"))


def range_violations(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Values below and above each range, the share inside, and a flag below 95 % and 90 %."""
    long = unpivot(df, [], list(ranges)).where(F.col("value").isNotNull())
    rows = df.sparkSession.createDataFrame([(f, float(lo), float(hi)) for f, (lo, hi) in ranges.items()], "feature string, lo double, hi double")
    out = long.join(F.broadcast(rows), "feature").groupBy("feature").agg(
        F.count_if(F.col("value") < F.col("lo")).alias("below"), F.count_if(F.col("value") > F.col("hi")).alias("above"), F.count("*").alias("n"))
    inside = (F.col("n") - F.col("below") - F.col("above")) / F.col("n") * 100
    return out.select("feature", "below", "above", inside.alias("within"), F.when(inside < 90, "high").when(inside < 95, "medium").otherwise("none").alias("severity"))


def iqr_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows outside the quartiles by 1.5 interquartile ranges, per feature."""
    long = unpivot(df, [], columns).where(F.col("value").isNotNull())
    q = quantiles(df, columns, (0.25, 0.75)).select("feature", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    spread = (F.col("q3") - F.col("q1")) * 1.5
    outside = (F.col("value") < F.col("q1") - spread) | (F.col("value") > F.col("q3") + spread)
    out = long.join(F.broadcast(q), "feature").groupBy("feature").agg(F.count_if(outside).alias("outliers"), F.count("*").alias("n"))
    return out.select("feature", "outliers", (F.col("outliers") / F.col("n") * 100).alias("percent"), (F.col("outliers") / F.col("n") * 100 > 5).alias("flagged"))


def sigma_anomalies(df: DataFrame, key: str, columns: Sequence[str], sigmas: float = 3.0) -> DataFrame:
    """Rows beyond the mean by ``sigmas`` standard deviations, with their z-score."""
    long = unpivot(df, [key], columns).where(F.col("value").isNotNull())
    moments = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    z = (F.col("value") - F.col("mean")) / F.col("std")
    return long.join(F.broadcast(moments), "feature").where(F.col("std") > 0).withColumn("z", z).where(F.abs("z") > sigmas).select(key, "feature", "value", "z")


def overview(df: DataFrame, flags: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(metric, value): totals, distinct counts, coverage, quality bands and completeness, in one aggregate."""
    n = F.count("*")
    measures = {
        "rows": n,
        "artists": F.countDistinct("artist_name"),
        "tracks": F.countDistinct("track_name"),
        "genres": F.countDistinct("genre"),
        **{f"on_{f}": F.count_if(F.col(f)) for f in flags},
        "multi_platform": F.count_if(reduce(lambda a, b: a + b, [F.col(f).cast("int") for f in flags]) > 1),
        "popular": F.count_if(F.col("normalized_popularity") >= 70),
        "middling": F.count_if((F.col("normalized_popularity") >= 40) & (F.col("normalized_popularity") < 70)),
        "obscure": F.count_if(F.col("normalized_popularity") < 40),
        **{f"complete_{c}": F.count(c) / n * 100 for c in columns},
    }
    row = df.agg(*[m.cast("double").alias(k) for k, m in measures.items()])
    return row.unpivot([], list(measures), "metric", "value")


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values and distinct values per column."""
    row = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(f"n_{c}") for c in columns], *[F.countDistinct(c).alias(f"d_{c}") for c in columns])
    rows = [F.struct(F.lit(c).alias("column"), (F.col("_n") - F.col(f"n_{c}")).alias("missing"), ((F.col("_n") - F.col(f"n_{c}")) / F.col("_n") * 100).alias("missing_percent"), F.col(f"d_{c}").alias("distinct")) for c in columns]
    return row.select(F.inline(F.array(*rows)))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per class: precision, recall, support; and the accuracy over all."""
    hit = F.col(label) == F.col(prediction)
    cells = df.groupBy(label, prediction).agg(F.count("*").alias("n"))
    truth = cells.groupBy(F.col(label).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits"))
    said = cells.groupBy(F.col(prediction).alias("class")).agg(F.sum("n").alias("said"))
    all_ = cells.agg((F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return truth.join(said, "class", "left").crossJoin(F.broadcast(all_)).select(
        "class", F.coalesce(F.col("hits") / F.col("said"), F.lit(0.0)).alias("precision"), (F.col("hits") / F.col("support")).alias("recall"), "support", "accuracy")


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Mean absolute error, R squared, and the percentage error over labels that aren't 0."""
    error = F.col(label) - F.col(prediction)
    return df.agg(
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.sum(error * error) / (F.var_pop(label) * F.count(label))).alias("r2"),
        F.avg(F.when(F.col(label) != 0, F.abs(error / F.col(label)) * 100)).alias("mape"),
    )


# The weights of the component scores, and the least overall score of each category.
QUALITY_WEIGHTS = {"data_completeness": 0.3, "data_consistency": 0.25, "source_diversity": 0.2, "platform_coverage": 0.15, "feature_quality": 0.1}
QUALITY_CATEGORIES = {"Excellent": 90, "Good": 80, "Fair": 70, "Poor": 60}


def quality_components(df: DataFrame, fields: Sequence[str], ranges: Mapping[str, tuple[float, float]], features: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """One row: the five component scores (0-100), the weighted overall score and its category.

    Completeness is the mean share of known ``fields``; consistency loses ten times the share of values outside each of
    ``ranges``; diversity adds ten times the mean source count to the percentage of rows with several sources; coverage is the
    mean share of ``flags``; a feature's quality falls with its variation and its outliers by the quartiles.
    """
    at_least = lambda c: F.greatest(F.lit(0.0), c)
    mean = lambda parts: reduce(lambda a, b: a + b, parts) / len(parts)
    outside = [F.coalesce(F.count_if((F.col(c) < lo) | (F.col(c) > hi)) / F.nullif(F.count(c), F.lit(0)), F.lit(0.0)) for c, (lo, hi) in ranges.items()]
    row = df.agg(
        mean([F.count(c) / F.count("*") * 100 for c in fields]).alias("data_completeness"),
        at_least(100 - reduce(lambda a, b: a + b, outside) * 10).alias("data_consistency"),
        F.least(F.lit(100.0), F.count_if(F.col("source_count") > 1) / F.count("*") * 100 + F.avg("source_count") * 10).alias("source_diversity"),
        mean([F.count_if(F.col(p)) / F.count("*") * 100 for p in flags]).alias("platform_coverage"),
    )
    moments = unpivot(df, [], features).where("value IS NOT NULL").groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    spread = F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(0.0)
    scored = moments.join(F.broadcast(iqr_outliers(df, features).select("feature", "percent")), "feature").agg(F.avg(at_least(100 - spread * 50 - F.col("percent") * 2)).alias("feature_quality"))
    whole = row.crossJoin(F.broadcast(scored)).na.fill(0.0)
    components = whole.select(*[F.round(c, 2).alias(c) for c in QUALITY_WEIGHTS])
    overall = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in QUALITY_WEIGHTS.items()])
    category = reduce(lambda w, x: w.when(F.col("overall") >= x[1], F.lit(x[0])), QUALITY_CATEGORIES.items(), F).otherwise("Critical")
    return components.withColumn("overall", overall).withColumns({"category": category, "overall": F.round("overall", 2)})
