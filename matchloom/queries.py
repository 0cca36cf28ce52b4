"""Registry of the queries over the driver's tables."""

from __future__ import annotations

from matchloom.plans import analysis, flows, scalar  # noqa: F401
from matchloom.plans.book import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
