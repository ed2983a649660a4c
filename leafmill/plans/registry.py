"""The registry of queries: a function of (spark, sf_dir), and the same result as SQL where SQL can say it."""

from __future__ import annotations

from leafmill.sources.tables import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def put(query):
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = with_views(sql)
        return query

    return put
