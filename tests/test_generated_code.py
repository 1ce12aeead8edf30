"""The cleaning jobs' generated methods stay below the 8,000 bytes beyond which the JVM would not compile them."""

from __future__ import annotations

import re

import pytest

import __spark_entry__
from resona.operators import cleaning, tables


@pytest.fixture
def largest(spark, monkeypatch, capfd):
    """largest(df): bytes of the largest generated method of ``df`` and of what was settled for it so far."""
    sizes = [0]

    def seen(df):
        capfd.readouterr()
        df.explain("codegen")
        sizes.extend(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capfd.readouterr().out))
        return max(sizes)

    settled = tables.settled
    monkeypatch.setattr(tables, "settled", lambda df: (seen(df), settled(df))[1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield seen
    spark.conf.unset("spark.sql.adaptive.enabled")


def _job(spark, sf_dir, name):
    return __spark_entry__.queries()[name](spark, sf_dir)


def test_track_cleaning_job(spark, sf_dir, largest):
    assert 0 < largest(_job(spark, sf_dir, "ds14_track_cleaning_job")) <= 8000


def test_catalog_cleaning_job(spark, sf_dir, largest):
    assert 0 < largest(_job(spark, sf_dir, "ds14_catalog_cleaning_job")) <= 8000


def test_yearly_cleaning_job(spark, sf_dir, largest):
    assert 0 < largest(_job(spark, sf_dir, "ds14_yearly_cleaning_job")) <= 8000


def test_white_space_of_every_kind_goes(spark):
    df = spark.createDataFrame([(1, " \x85 a b 　\n\r\n", "x", 1.0), (2, "  \x0b\t", "x", 1.0)], "n int, track_id string, track_name string, energy double")
    assert [r.track_id for r in cleaning.track_table(df, ["n"]).collect()] == ["a b"]


def test_first_row_tells_ties_by_the_rest_of_the_row(spark):
    rows = [("a", 1, "y", 1.0), ("a", 1, "x", 2.0), ("a", None, "z", 3.0), ("b", None, None, None)]
    for turned in (rows, rows[::-1]):
        df = spark.createDataFrame(turned, "key string, n int, t string, x double")
        assert sorted(map(tuple, tables.first_row(df.where("n IS NOT NULL OR key = 'b'"), ["key"], ["n"]).collect())) == [("a", 1, "x", 2.0), ("b", None, None, None)]
    with_map = spark.sql("SELECT * FROM VALUES ('a', 2, map('k', 1)), ('a', 1, map('k', 2)) AS v(key, n, m)")
    assert [r.m for r in tables.first_row(with_map, ["key"], ["n"]).collect()] == [{"k": 2}]
