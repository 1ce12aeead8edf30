"""Imputing, repairing and merging catalog rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.operators.quantiles import group_quantiles, quantile_row
from resona.operators.scores import PLATFORMS, data_quality
from resona.operators.tables import lone_and_shared, settled

# Default audiences by genre word, in order.
GENRE_AUDIENCES = {
    "pop": ("18-34", "35-49"),
    "rock": ("25-49", "50+"),
    "hip hop": ("16-34", "35-49"),
    "rap": ("16-34", "35-49"),
    "electronic": ("18-34", "16-24"),
    "country": ("35-65", "25-49"),
    "jazz": ("35+", "25-49"),
    "classical": ("50+", "35-64"),
    "r&b": ("25-49", "18-34"),
    "soul": ("35-64", "25-49"),
}
# Popularity by platform where nothing else is known.
PLATFORM_DEFAULTS = {"spotify": 45.0, "youtube": 35.0, "tiktok": 55.0}

#: genres whose means are broadcast
MOST_GENRES = 100_000


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Gaps take the column's exact median."""
    row = quantile_row(df, columns, (0.5,)).select(*[F.col(c)[0].alias(f"_m_{c}") for c in columns])
    return df.crossJoin(F.broadcast(row)).withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Gaps take the most frequent value, the smallest of equals."""
    row = df.agg(*[F.mode(c, True).alias(f"_m_{c}") for c in columns])
    return df.crossJoin(F.broadcast(row)).withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def fill_by_group(df: DataFrame, group: str, columns: Sequence[str], how=None) -> DataFrame:
    """Gaps take their group's figure (the exact median, or the aggregate ``how``), then the overall one. Both come from the original values."""
    if how is None:
        groups = group_quantiles(df, group, columns, (0.5,)).select(F.col(group).alias("_group"), *[F.col(c)[0].alias(f"_g_{c}") for c in columns])
        row = quantile_row(df, columns, (0.5,)).select(*[F.col(c)[0].alias(f"_a_{c}") for c in columns])
    else:
        groups = df.groupBy(group).agg(*[how(c).alias(f"_g_{c}") for c in columns]).withColumnRenamed(group, "_group")
        row = df.agg(*[how(c).alias(f"_a_{c}") for c in columns])
    out = df.join(groups, df[group] == F.col("_group"), "left").crossJoin(F.broadcast(row))
    return out.withColumns({c: F.coalesce(c, f"_g_{c}", f"_a_{c}") for c in columns}).drop("_group", *[f"_g_{c}" for c in columns], *[f"_a_{c}" for c in columns])


def replace_invalid(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Values outside [low, high] take the median of those inside."""
    valid = F.col(column).between(low, high)
    row = quantile_row(df.where(valid), [column], (0.5,)).select(F.col(column)[0].alias("_m"))
    return df.crossJoin(F.broadcast(row)).withColumn(column, F.when(valid, F.col(column)).otherwise(F.col("_m"))).drop("_m")


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.col(c).isNull() for c in columns})


def audience_defaults(genre: Column) -> Column:
    """struct(primary, secondary) of the first genre word the text contains."""
    out = F
    for word, (first, second) in GENRE_AUDIENCES.items():
        out = out.when(F.lower(genre).contains(word), F.struct(F.lit(first).alias("primary"), F.lit(second).alias("secondary")))
    return out.otherwise(F.struct(F.lit("18-49").alias("primary"), F.lit("all_ages").alias("secondary")))


def composite_popularity(df: DataFrame, popularity: str, counts: Sequence[str]) -> DataFrame:
    """Adds normalized_popularity: mean of the popularity (50 if null) and each count's log scaled to 0-100, within 0-100.

    A count without spread is left out of the mean.
    """
    log = lambda c: F.log10(F.when(F.coalesce(c, F.lit(0)) == 0, 1).otherwise(F.col(c)).cast("double"))
    row = df.agg(*[f(log(c)).alias(f"_{n}_{c}") for c in counts for n, f in (("lo", F.min), ("hi", F.max))])
    parts = [F.coalesce(popularity, F.lit(50.0))] + [F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (log(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) * 100) for c in counts]
    total, n = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts]), reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in parts])
    out = df.crossJoin(F.broadcast(row)).withColumn("normalized_popularity", F.least(F.greatest(total / n, F.lit(0.0)), F.lit(100.0)))
    return out.drop(*[f"_{n}_{c}" for c in counts for n in ("lo", "hi")])


def platform_popularity(df: DataFrame) -> DataFrame:
    """Adds normalized_popularity from avg_popularity by platform: tiktok before youtube before spotify; null elsewhere."""
    value = F.col("avg_popularity").cast("double")
    log = F.log10(F.when(value == 0, 1.0).otherwise(value))
    ends = quantile_row(df.where("youtube").select(log.alias("log")), ["log"], (0.01, 0.99)).select(F.col("log")[0].alias("_y1"), F.col("log")[1].alias("_y99"))
    # written, so that what reads the result doesn't replay it
    row = settled(df.agg(F.min(F.when(F.col("tiktok"), value)).alias("_t0"), F.max(F.when(F.col("tiktok"), value)).alias("_t1")).crossJoin(F.broadcast(ends)))
    score = (
        F.when(value.isNull(), F.lit(None).cast("double"))
        .when(F.col("tiktok"), F.when(F.col("_t1") <= 100, value).otherwise((value - F.col("_t0")) / (F.col("_t1") - F.col("_t0")) * 100))
        .when(F.col("youtube"), F.least(F.greatest((log - F.col("_y1")) / (F.col("_y99") - F.col("_y1")) * 100, F.lit(0.0)), F.lit(100.0)))
        .when(F.col("spotify"), F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0))))
    return df.crossJoin(F.broadcast(row)).withColumn("normalized_popularity", score).drop("_y1", "_y99", "_t0", "_t1")


def fill_popularity(df: DataFrame, defaults: Mapping[str, float] = PLATFORM_DEFAULTS, last: float = 40.0) -> DataFrame:
    """Gaps take the mean of their known genre, then the default of their first platform, then ``last``; all within 0-100."""
    means = settled(df.where("genre <> 'unknown'").groupBy("genre").agg(F.avg("normalized_popularity").alias("_mean")))
    means = F.broadcast(means) if means.count() <= MOST_GENRES else means
    by_platform = reduce(lambda w, p: w.when(F.col(p[0]), F.lit(p[1])), defaults.items(), F)
    filled = F.coalesce("normalized_popularity", "_mean", by_platform.otherwise(F.lit(last)))
    return df.join(means, "genre", "left").withColumn("normalized_popularity", F.least(F.greatest(filled, F.lit(0.0)), F.lit(100.0))).drop("_mean")


def repair_platforms(df: DataFrame, source: str = "primary_source") -> DataFrame:
    """Flags from the source's name; a row on no platform counts as spotify."""
    has = {p: F.coalesce(F.col(source).contains(p), F.lit(False)) for p in PLATFORMS}
    none = ~reduce(lambda a, b: a | b, has.values())
    return df.withColumns({**has, "spotify": has["spotify"] | none})


def infer_genre() -> Column:
    """Unknown genres by five features, in order."""
    d, e, v, a, i = (F.col(c) for c in ("danceability", "energy", "valence", "acousticness", "instrumentalness"))
    guess = (
        F.when(d.isNull() | e.isNull(), "unknown")
        .when((d > 0.7) & (e > 0.7) & (a < 0.3), "electronic")
        .when((d > 0.6) & (e > 0.5) & (v > 0.5), "pop")
        .when((a > 0.7) & (e < 0.5), "acoustic")
        .when((e > 0.6) & (a < 0.2) & (d > 0.6), "hip hop")
        .when(i > 0.7, "classical")
        .otherwise("pop"))
    return F.when(F.col("genre") == "unknown", guess).otherwise(F.col("genre"))


def engagement_popularity(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Adds engagement_popularity: weighted min-max scaled counts, 0-100; null counts are 0."""
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in weights}
    row = df.agg(*[f(v).alias(f"_{n}_{c}") for c, v in value.items() for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = [F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (value[c] - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(0.0) * (w / sum(weights.values())) for c, w in weights.items()]
    return df.crossJoin(F.broadcast(row)).withColumn("engagement_popularity", reduce(lambda a, b: a + b, scaled) * 100).drop(*[f"_{n}_{c}" for c in weights for n in ("lo", "hi")])


#: rows up to which a group's medians and modes are taken inside the group
MOST_GATHERED = 10_000
#: buckets of hashes that are counted to find groups of more rows
SIZE_BUCKETS = 1 << 17


def _median_in(rows: Column, field: str) -> Column:
    """The exact median of a field of an array of structs; null without values."""
    values = F.array_sort(F.filter(F.transform(rows, lambda r: r[field].cast("double")), lambda x: x.isNotNull()))
    n = F.size(values)
    low, high = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
    return F.when(n > 0, F.when(low == high, low).otherwise((low + high) / 2))


def _mode_in(rows: Column, field: str) -> Column:
    """The most frequent known value of a field of an array of structs, the smallest of equals; 'unknown' without one."""
    values = F.filter(F.transform(rows, lambda r: r[field]), lambda x: x.isNotNull() & (x != "unknown"))
    counted = F.transform(F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("minus"), v.alias("v")))
    return F.coalesce(F.get(F.array_sort(counted), F.lit(0))["v"], F.lit("unknown"))


def _merged(df: DataFrame, group: str, aggregates: Sequence[Column], features: Sequence[str], few: int) -> DataFrame:
    """Per group: ``aggregates``, the medians of its features and its modal known genre.

    A group of at most ``few`` rows is gathered in one buffer; larger ones, at most one
    in ``few`` rows, have their medians selected and their genres counted.
    """

    def gathered(rows: DataFrame) -> DataFrame:
        # rows are shuffled as they are: groups are small, and buffers of single rows take several times their room
        found = rows.repartition(group).groupBy(group).agg(*aggregates, F.collect_list(F.struct(*features, "genre")).alias("_rows"))
        figures = {f: _median_in(F.col("_rows"), f) for f in features} | {"genre": _mode_in(F.col("_rows"), "genre")}
        return found.withColumns(figures).drop("_rows")

    # a group is at most as large as its bucket of hashes, so the keys of small buckets needn't be counted
    bucket = F.pmod(F.xxhash64(group), F.lit(SIZE_BUCKETS)).cast("int")
    crowded = [r["_b"] for r in df.groupBy(bucket.alias("_b")).agg(F.count("*").alias("_n")).where(F.col("_n") > few).select("_b").collect()]
    if not crowded:
        return gathered(df)
    near = df.where(bucket.isin(crowded)) if len(crowded) <= 1000 else df
    large = settled(near.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > few).select(group))
    if large.isEmpty():
        return gathered(df)
    hot = df.join(large, group, "left_semi")
    medians = group_quantiles(hot, group, features, (0.5,)).select(group, *[F.col(f)[0].alias(f) for f in features])
    counted = hot.where("genre <> 'unknown'").groupBy(group, "genre").agg(F.count("*").alias("_n"))
    genres = counted.groupBy(group).agg(F.min_by("genre", F.struct(-F.col("_n"), "genre")).alias("genre"))
    found = hot.groupBy(group).agg(*aggregates).join(medians, group, "left").join(genres, group, "left")
    return gathered(df.join(large, group, "left_anti")).unionByName(found.withColumn("genre", F.coalesce("genre", F.lit("unknown"))))


def merge_groups(df: DataFrame, group: str, features: Sequence[str], base: Sequence[str] = ("track_name", "artist_name"), few: int = MOST_GATHERED) -> DataFrame:
    """One master row per group: base fields by priority, median features, popularity, modal known genre, sources and flags. Rows without a group are left out."""
    order = F.struct("source_priority", "source_dataset", "rec_id")
    aggregates = [
        F.min(F.struct(order.alias("order"), *base, "source_dataset")).alias("first"),
        F.count("*").alias("record_count"),
        F.sort_array(F.collect_set("source_dataset")).alias("all_sources"),
        F.avg("popularity_score").alias("avg_popularity"),
        F.max("popularity_score").alias("max_popularity"),
    ]
    return _masters(_merged(df.where(F.col(group).isNotNull()), group, aggregates, features, few), group, features, base)


def _masters(met: DataFrame, group: str, features: Sequence[str], base: Sequence[str]) -> DataFrame:
    return met.select(
        group, *[F.col("first")[c].alias(c) for c in base], F.col("first.source_dataset").alias("primary_source"), "record_count",
        F.size("all_sources").cast("long").alias("source_count"), "all_sources", *features, "avg_popularity", "max_popularity", "genre",
        *[F.expr(f"exists(all_sources, s -> contains(s, '{p}'))").alias(p) for p in PLATFORMS])


def merge_few_groups(df: DataFrame, group: str, features: Sequence[str], base: Sequence[str] = ("track_name", "artist_name"), few: int = MOST_GATHERED) -> DataFrame:
    """As ``merge_groups`` over a settled table most of whose groups have one row.

    A row alone in its group is its master. Only the rows of other groups are shuffled, and their masters written.
    """
    lone, shared = lone_and_shared(df.where(F.col(group).isNotNull()), [group])
    merged = settled(merge_groups(shared, group, features, base, few))
    if lone is None:
        return merged
    kind = {f.name: f.dataType for f in merged.schema.fields}
    known = F.nullif(F.col("genre"), F.lit("unknown"))
    alone = lone.select(
        group, F.struct(*base, "source_dataset").alias("first"), F.lit(1).cast("long").alias("record_count"), F.array_compact(F.array("source_dataset")).alias("all_sources"), *[F.col(f).cast(kind[f]).alias(f) for f in features],
        F.col("popularity_score").cast(kind["avg_popularity"]).alias("avg_popularity"), F.col("popularity_score").alias("max_popularity"), F.coalesce(known, F.lit("unknown")).alias("genre"))
    return _masters(alone, group, features, base).unionByName(merged)


def with_master_id(masters: DataFrame, group: str) -> DataFrame:
    """master_id: a hash of the group's key, the same in every run."""
    return masters.withColumn("master_id", F.sha2(F.col(group), 256))


def id_mapping(df: DataFrame, group: str) -> DataFrame:
    """master_id with its (source, record) pairs. Ids are shuffled as bytes, which take half of their text's room."""
    records = F.array_sort(F.collect_list(F.struct(F.col("source_dataset").alias("source"), F.col("rec_id").alias("record"))))
    return df.groupBy(F.unhex(F.sha2(F.col(group), 256)).alias("_id")).agg(records.alias("records")).select(F.lower(F.hex("_id")).alias("master_id"), "records")


def merge_duplicates(df: DataFrame, keys: Sequence[str], features: Sequence[str], few: int = MOST_GATHERED) -> DataFrame:
    """Rows with equal keys merged around the best-scored one, and scored again."""
    aggregates = [
        F.max_by(F.struct("rec_id", "source_dataset"), F.struct(data_quality(), "rec_id")).alias("best"), F.count("*").alias("merged"), F.max("normalized_popularity").alias("normalized_popularity"),
        F.max("source_count").alias("source_count"), *[F.bool_or(p).alias(p) for p in PLATFORMS]]
    out = _merged(df.withColumn("_key", F.struct(*keys)), "_key", aggregates, features, few)
    out = out.select("_key.*", *[c for c in out.columns if c != "_key"])
    return out.withColumn("rec_id", F.col("best.rec_id")).drop("best").withColumn("data_quality_score", data_quality())
