"""Every catalog query against its SQL; those without SQL must return rows with a stable schema."""

from __future__ import annotations

import pytest
from compare import same

from resona.plans import registry

ORACLES = registry.oracle_sql()
MAY_BE_EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    assert df.columns == registry.queries()[name](spark, sf_dir).columns
    assert df.count() > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert {"master_id", "ar_score"} <= set(df.columns) and df.count() > 0
