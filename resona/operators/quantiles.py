"""Exact quantiles by distributed selection: no task ever holds a column's values.

A quantile is one or two order statistics. Each pass counts the rows of every interval still open in
``buckets`` equal parts, keeps the part that holds the wanted rank, and goes on inside the
part's own least and greatest value. An interval whose ends meet is the answer. A pass divides the
rows in question by about ``buckets``, so a thousand million values take three; the ends of
an interval lie in different parts, so every pass narrows it, whatever the values.

Groups are selected all at once: the table of open intervals has a few rows for each group and
feature. It is broadcast while it has at most ``few`` rows and joined by shuffle beyond.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resona.operators.tables import settled, unpivot


def _part(value: Column, low: Column, high: Column, buckets: int) -> Column:
    """Which part of [low, high] holds the value; values that aren't finite lie before or behind all parts."""
    width = high / 2 - low / 2  # halved, so that no width overflows
    inside = F.least(F.floor((value / 2 - low / 2) / width * buckets), F.lit(buckets - 1))
    return (
        F.when(F.isnan(value), buckets + 1).when(value == float("inf"), buckets).when(value == float("-inf"), -1)
        .when(width > 0, inside).otherwise(F.when(value > low, 1).otherwise(0)).cast("int"))


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = (), buckets: int = 1024, few: int = 100_000) -> DataFrame:
    """(by..., feature, n, q): the exact quantiles, interpolated between neighbours, as an array in the order of ``probabilities``.

    Nulls don't count; NaN is the greatest value. A feature without values, and rows with a null in ``by``, give no row.
    """
    by = list(by)
    keys = [*by, "feature"]
    wide = settled(df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, "value"]])
    values = unpivot(wide, by, columns).where(known)
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    end = lambda f: F.coalesce(f(F.when(finite, F.col("value"))), F.lit(0.0))
    ends = values.groupBy(*keys).agg(F.count("*").alias("n"), end(F.min).alias("low"), end(F.max).alias("high"))
    place = [F.lit(float(p)) * (F.col("n") - 1) for p in probabilities]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in place for f in (F.floor, F.ceil)]))
    open_ = settled(ends.select(*keys, "n", "low", "high", F.lit(0).cast("long").alias("below"), F.explode(ranks).alias("rank")))
    found, first = [], True
    interval = [*keys, "low", "high"]
    while not open_.isEmpty():
        asked = open_.select(*interval).distinct()
        asked = F.broadcast(asked) if open_.count() <= few else asked
        held = values.join(asked, keys)
        held = held if first else held.where(F.col("value").between(F.col("low"), F.col("high")))
        part = _part(F.col("value"), F.col("low"), F.col("high"), buckets)
        counted = held.groupBy(*interval, part.alias("part")).agg(F.count("*").alias("here"), F.min("value").alias("least"), F.max("value").alias("most"))
        upto = F.sum("here").over(Window.partitionBy(*interval).orderBy("part"))
        chosen = open_.join(counted.withColumn("upto", upto), interval).where("rank - below >= upto - here AND rank - below < upto")
        narrowed = settled(chosen.select(*keys, "n", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("below") + F.col("upto") - F.col("here")).alias("below"), "rank"))
        found.append(narrowed.where("low = high").select(*keys, "n", "rank", F.col("low").alias("value")))
        open_, first = narrowed.where("low < high"), False
    if not found:
        return wide.limit(0).select(*by, F.lit("").alias("feature"), F.lit(0).cast("long").alias("n"), F.array(F.lit(0.0)).alias("q"))
    at = reduce(DataFrame.unionByName, found).groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))

    def between(x: Column) -> Column:
        low, high = F.col("at")[F.floor(x).cast("long")], F.col("at")[F.ceil(x).cast("long")]
        return F.when(low == high, low).otherwise(low + (high - low) * (x - F.floor(x)))

    return at.select(*keys, "n", F.array(*[between(x) for x in place]).alias("q"))


def quantile_row(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """One row with the array of each column's quantiles under the column's name; null for a column without values."""
    found = quantiles(df, columns, probabilities)
    return found.agg(*[F.max(F.when(F.col("feature") == c, F.col("q"))).alias(c) for c in columns])


def group_quantiles(df: DataFrame, group: str, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """One row per group with the array of each column's quantiles under the column's name."""
    found = quantiles(df, columns, probabilities, by=[group])
    return found.groupBy(group).agg(*[F.max(F.when(F.col("feature") == c, F.col("q"))).alias(c) for c in columns])
