"""A data source over a search that is paged by a cursor.

The fetching function is given by the caller, so any service can be put behind it: fetch(cursor) returns (rows, next cursor or None).  Reading stops at an
empty page, a missing cursor, a cursor that was seen before, or ``limit`` rows.  Batches split by query.

Streams take the queries one after the other, a page at a time.  Their offset moves on with every page, also past the last, and says all that a restart
needs: the query, the cursor, pages and rows so far, and a cursor to tell loops by.  ``rate`` bounds the pages fetched in a second, over all partitions.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

Fetch = Callable[[str], tuple[list[tuple], str | None]]


def walk(fetch: Fetch, start: str = "*", limit: int | None = None) -> Iterator[tuple]:
    """All rows behind a cursor."""
    cursor, seen, given = start, set(), 0
    while cursor is not None and cursor not in seen:
        seen.add(cursor)
        rows, cursor = fetch(cursor)
        if not rows:
            return
        for row in rows:
            if limit is not None and given >= limit:
                return
            yield row
            given += 1


def patiently(call: Callable[[], object], tries: int = 4, pause: float = 1.0, again: tuple = (429, 500, 502, 503, 504), sleep: Callable = time.sleep) -> object:
    """Calls until it works; failures with one of the codes wait twice as long each time, with jitter, and others are raised."""
    for n in range(tries):
        try:
            return call()
        except Exception as e:
            if getattr(e, "code", None) not in again or n == tries - 1:
                raise
            sleep(pause * 2**n + random.random() * pause)
    raise AssertionError


class Throttle:
    """Waits so that calls are ``rate`` a second at most; each of several partitions that share a rate gets its part of it."""

    def __init__(self, rate: float | None, shared_by: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap = shared_by / rate if rate else 0.0
        self.clock, self.sleep, self.free_at = clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.free_at is not None and now < self.free_at:
            self.sleep(self.free_at - now)
            now = self.free_at
        self.free_at = now + self.gap

    def around(self, fetch: Fetch) -> Fetch:
        def throttled(cursor: str) -> tuple[list[tuple], str | None]:
            self.wait()
            return fetch(cursor)

        return throttled


class _Query(InputPartition):
    def __init__(self, query: str):
        self.query = query


class _Reader(DataSourceReader):
    def __init__(self, queries: list[str], fetch_for: Callable[[str], Fetch], limit: int | None, rate: float | None):
        self.queries, self.fetch_for, self.limit, self.rate = queries, fetch_for, limit, rate

    def partitions(self) -> list[InputPartition]:
        return [_Query(q) for q in self.queries]

    def read(self, partition: _Query) -> Iterator[tuple]:
        yield from walk(Throttle(self.rate, len(self.queries)).around(self.fetch_for(partition.query)), limit=self.limit)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, queries: list[str], fetch_for: Callable[[str], Fetch], limit: int | None, rate: float | None):
        throttle = Throttle(rate)
        self.fetches, self.limit = [throttle.around(fetch_for(q)) for q in queries], limit

    def initialOffset(self) -> dict:
        return _offset(0)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """The next page with rows, over queries that have ended."""
        at = start
        while at["query"] < len(self.fetches):
            rows, at = self._page(at)
            if rows:
                return iter(rows), at
        return iter(()), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start
        while (at["query"], at["page"]) < (end["query"], end["page"]):
            rows, at = self._page(at)
            yield from rows

    def _page(self, at: dict) -> tuple[list[tuple], dict]:
        """The page at an offset, and the offset behind it."""
        rows, cursor = self.fetches[at["query"]](at["cursor"])
        if self.limit is not None:
            rows = rows[: self.limit - at["rows"]]
        given = at["rows"] + len(rows)
        # a loop of cursors comes back to the mark, which moves up whenever the pages have doubled
        if not rows or cursor is None or cursor in (at["cursor"], at["mark"]) or given == self.limit:
            return rows, _offset(at["query"] + 1)
        page = at["page"] + 1
        return rows, {"query": at["query"], "cursor": cursor, "page": page, "rows": given, "mark": cursor if page & (page - 1) == 0 else at["mark"]}


def _offset(query: int) -> dict:
    """Before the first page of a query; behind all queries, the end."""
    return {"query": query, "cursor": "*", "page": 0, "rows": 0, "mark": "*"}


def paged_source(name: str, schema: str, fetch_for: Callable[[str], Fetch]) -> type[DataSource]:
    """A data source class to register; its options are ``queries`` (a list separated by line feeds), ``limit`` and ``rate``."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def _settings(self) -> tuple[list[str], Callable[[str], Fetch], int | None, float | None]:
            limit, rate = self.options.get("limit"), self.options.get("rate")
            return self.options.get("queries", "").split("\n"), fetch_for, int(limit) if limit else None, float(rate) if rate else None

        def reader(self, schema: object) -> DataSourceReader:
            return _Reader(*self._settings())

        def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:
            return _Stream(*self._settings())

    return Paged
