"""A decorator that keeps a query next to the SQL it must agree with."""

from __future__ import annotations


def register(queries: dict, oracles: dict):
    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return keep

    return query
