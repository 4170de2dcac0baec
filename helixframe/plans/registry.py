"""Where driver queries register: the function by its name, and SQL that says the same if there is one."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put
