"""Named queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        #: What queries keep between calls in one session (trained models); emptied by whoever measures them.
        self.caches: list[dict] = []

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add


core = Registry()

#: SQL of the distinct records with the given select list, as :func:`fluxmill.sources.tables.records` makes them.
RECORDS = "(SELECT DISTINCT sid, seq, CASE WHEN sid IS NULL OR seq IS NULL THEN autoid END AS own, {} FROM argus)"
SADDR, DADDR = "lower(trim(saddr)) AS saddr", "lower(trim(daddr)) AS daddr"
DAY = "strftime(make_timestamp(stime_us), '%Y-%m-%d')"
