"""Column functions on numbers, categories and dates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TOKENS = ("nan", "NaN", "None", "", "N/A", "n/a", "null")


def to_number(column: Column) -> Column:
    """A double, or null where the text is none."""
    return column.try_cast("double")


def messy_number(column: Column) -> Column:
    """Numbers with thousands separators; null tokens become null."""
    cleaned = F.regexp_replace(column, "[, ]", "")
    return F.when(~cleaned.isin(*NULL_TOKENS), cleaned).try_cast("double")


def percent_number(column: Column) -> Column:
    return F.trim(F.replace(column, F.lit("%"), F.lit(""))).try_cast("double")


def flexible_boolean(column: Column) -> Column:
    """true, 1 and yes are true; everything else is false."""
    return F.coalesce(F.lower(F.trim(column.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def any_date(column: Column, formats: Sequence[str] = ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy")) -> Column:
    return F.coalesce(*[F.try_to_timestamp(column, F.lit(f)) for f in formats])


def null_tokens(column: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    return F.when(~column.isin(*tokens), column)


def within(column: Column, low: float, high: float) -> Column:
    """The value, or null outside [low, high]."""
    return F.when(column.between(low, high), column)


def clip(column: Column, low: float, high: float) -> Column:
    return F.when(column.isNotNull(), F.least(F.greatest(column, F.lit(float(low))), F.lit(float(high))))


def cut_bins(column: Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Right-closed bins (a, b]; the lowest edge itself is outside unless ``include_lowest``."""
    out = F.when((column < edges[0]) if include_lowest else (column <= edges[0]), F.lit(None).cast("string"))
    for high, label in zip(edges[1:], labels, strict=True):
        out = out.when(column <= high, F.lit(label))
    return out


def equal_width_bin(column: Column, low: Column, high: Column, bins: int) -> Column:
    """1..bins by equal width over [low, high], right-closed; the lowest value falls in bin 1."""
    width = (high - low) / bins
    return F.when(high > low, F.least(F.greatest(F.ceil((column - low) / width), F.lit(1)), F.lit(bins))).otherwise(F.when(column.isNotNull(), F.lit(1))).cast("int")


def tiers(column: Column, steps: Sequence[tuple[float, str]], lowest: str, missing: str = "unknown") -> Column:
    """The first tier whose threshold the value reaches."""
    out = F.when(column.isNull(), F.lit(missing))
    for threshold, label in steps:
        out = out.when(column >= threshold, F.lit(label))
    return out.otherwise(F.lit(lowest))


def min_max(column: Column, low, high, scale: float = 1.0) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.when(high > low, (column - low) / (high - low) * scale)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def row_mean(*columns: Column, of: Sequence[Column] | None = None) -> Column:
    """Mean of the values that are there; ``of`` may name plain columns that are null where the values are.

    The count goes over an array. That keeps Spark from fusing a table of many means into
    one generated method, which beyond 8,000 bytes the JVM would not compile.
    """
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    count = F.size(F.array_compact(F.array(*(of or columns))))
    return F.when(count > 0, total / count)


def completeness(*columns: Column) -> Column:
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns]) / len(columns)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days between two times, rounded down."""
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86400)


def best_of(scores: dict[str, Column]) -> Column:
    """Name of the largest score; the earlier name wins ties."""
    rows = [F.struct(s.alias("score"), F.lit(-k).alias("k"), F.lit(n).alias("name")) for k, (n, s) in enumerate(scores.items())]
    return F.array_max(F.array(*rows))["name"]


def ranked(scores: dict[str, Column]) -> Column:
    """Array of struct(name, score), best first."""
    rows = [F.struct((-s).alias("minus"), F.lit(k).alias("k"), F.lit(n).alias("name"), s.alias("score")) for k, (n, s) in enumerate(scores.items())]
    return F.transform(F.array_sort(F.array(*rows)), lambda r: F.struct(r["name"].alias("name"), r["score"].alias("score")))
