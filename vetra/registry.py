"""All queries of the library proper, by name, with their SQL."""

from __future__ import annotations

from .plans import catalog, code_catalog, facts_catalog, source_catalog  # noqa: F401 - the others add their queries to the first one's


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
