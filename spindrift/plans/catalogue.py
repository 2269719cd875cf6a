"""The queries of the engine by name, each over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from . import extraction, relational, runs, scalars, state
from .base import QUERIES, SQL, Query

flagship = extraction.flagship
MODULES = (extraction, relational, runs, scalars, state)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
