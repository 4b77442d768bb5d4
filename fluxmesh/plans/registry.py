"""Registered field queries and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return wrap


from fluxmesh.plans import field_queries, identity_queries, mesh_queries, order_queries, solve_queries, space_queries  # noqa: E402, F401  they register themselves
