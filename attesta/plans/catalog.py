"""All queries over the driver tables."""

from __future__ import annotations

from attesta.plans import claims, delivery, history, linking, pages, reports, roundtrips, tables  # noqa: F401  registers queries
from attesta.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
