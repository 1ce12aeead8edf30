"""Similarity scorers for short strings, 0-100, as Arrow functions over whole batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over b's characters."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit) | (row - hit)
    return len(a) - bin(row & ((1 << len(a)) - 1)).count("1")


def ratio_of(a: str, b: str) -> float:
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_of(a: str, b: str) -> float:
    """Best ratio of the shorter text with a stretch of the longer one of at most its length."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    cuts = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(ratio_of(short, c) for c in cuts if c)


def _sorted_tokens(t: str) -> str:
    return " ".join(sorted(t.split()))


def token_set_of(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = ratio_of(one, two)
    return max(best, ratio_of(both, one), ratio_of(both, two)) if both else best


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio_of(x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio_of(_sorted_tokens(x), _sorted_tokens(y)) if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_of(x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("ratio", "partial", "token_sort", "token_set")]))
def all_scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = [(ratio_of(x, y), partial_of(x, y), ratio_of(_sorted_tokens(x), _sorted_tokens(y)), token_set_of(x, y)) if x and y else (0.0,) * 4 for x, y in zip(a, b, strict=True)]
    return pd.DataFrame(rows, columns=["ratio", "partial", "token_sort", "token_set"], dtype=float)


def weighted(scores: Column) -> Column:
    """Ratio .25, partial .15, token sort .35, token set .25."""
    return scores["ratio"] * 0.25 + scores["partial"] * 0.15 + scores["token_sort"] * 0.35 + scores["token_set"] * 0.25


def edit_ratio(a: Column, b: Column) -> Column:
    """100 minus the edit distance as a percentage of the longer text; JVM-side."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest > 0, (1 - F.levenshtein(a, b) / longest) * 100).otherwise(100.0)


def likely_match(artist: Column, track: Column, threshold: float = 85, strict: bool = True) -> Column:
    """Whether two scored name pairs are the same song."""
    if strict:
        return (artist >= 90) & (track >= threshold)
    return (artist * 0.6 + track * 0.4 >= threshold) & (artist >= 70) & (track >= 70)
