"""Registry of the catalog queries and their SQL oracles."""

from __future__ import annotations

from resona.plans import cleaning, columns, datasets, insight, relations, reporting, scoring  # noqa: F401  (they register their queries)
from resona.plans.query import ORACLES, QUERIES
from resona.sources.fixtures import view


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


def flagship(spark, sf_dir):
    return scoring.flagship(view(spark, sf_dir, "tracks"))
