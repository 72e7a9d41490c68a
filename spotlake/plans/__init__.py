"""Registered queries of the core; each module has ``QUERIES`` and, where SQL can say the same, ``SQL``."""

from spotlake.operators.scale import scoped
from spotlake.plans import areas, events, measure, quality, reviews

MODULES = [quality, measure, areas, reviews, events]


def queries() -> dict:
    return {k: scoped(v) for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
