"""Named queries over the test tables and their SQL. A query's name is that of the operator it shows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
DEFERRED: dict[str, Callable[[], str]] = {}


def query(sql: str | None = None, deferred: Callable[[], str] | None = None) -> Callable:
    """Registers a query with its SQL, or with what makes it from other queries' SQL once all are registered."""

    def added(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        if deferred:
            DEFERRED[f.__name__] = deferred
        return f

    return added


def queries() -> dict[str, Callable]:
    from kerbline.plans import evidence, further, keeping, lookups, roads, rules, streams, text, traffic, travel  # noqa: F401  they register themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return SQL | {name: made() for name, made in DEFERRED.items()}
