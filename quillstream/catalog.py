"""All queries of the engine by name, and the SQL that says the same."""

from __future__ import annotations

from .plans import dimensions, exact, extras, geometry, protocol, quality, signal, similarity, simulate  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
