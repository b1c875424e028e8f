"""Where registered queries are kept, each with the SQL of its result."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, *ctes: str):
    """Register a query under its name, with the SQL of its result."""

    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return keep
