"""Registered queries of the library."""

from contestlab.plans import core, decisions, features, marts  # noqa: F401  (they register their queries)
from contestlab.plans.base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
