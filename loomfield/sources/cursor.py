"""A Python data source that harvests cursor-paged interfaces: one partition per query, pages followed until no cursor is left."""

from __future__ import annotations

import importlib
import json
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TIMEOUT, RETRIES = 30, 3


def http_page(url: str, query: str, cursor: str, size: int) -> tuple[list[dict], str | None]:
    """One page of a JSON interface that takes `query`, `cursor` (`*` at first) and `per_page` and gives `results` and
    `meta.next_cursor`; a page that can't be read is asked for again a few times."""
    address = f"{url}?{urlencode({'query': query, 'cursor': cursor, 'per_page': size})}"
    for left in range(RETRIES - 1, -1, -1):
        try:
            with urlopen(address, timeout=TIMEOUT) as answer:
                page = json.load(answer)
            break
        except OSError:
            if not left:
                raise
    rows = page.get("results") or []
    return rows, (page.get("meta") or {}).get("next_cursor") if rows else None


class _Query(InputPartition):
    def __init__(self, query: str) -> None:
        self.query = query


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.url, self.size = options.get("url"), int(options.get("per_page", "200"))
        self.fetch = options.get("fetch")
        if bool(self.url) == bool(self.fetch):
            raise ValueError("the cursor source needs either `url` or `fetch`")
        self.queries = json.loads(options.get("queries", '[""]'))

    def partitions(self):
        return [_Query(q) for q in self.queries]

    def _page(self, query: str, cursor: str):
        if self.url:
            return http_page(self.url, query, cursor, self.size)
        module, _, name = self.fetch.partition(":")
        return getattr(importlib.import_module(module), name)(query, cursor)

    def read(self, partition):
        cursor, seen = "*", set()
        while cursor is not None and cursor not in seen:  # a cursor that comes again would never end
            seen.add(cursor)
            rows, cursor = self._page(partition.query, cursor)
            for row in rows:
                yield partition.query, json.dumps(row)


class CursorSource(DataSource):
    """Options: `url`, the address of an interface as http_page has it (with `per_page`), or `fetch`, a function module:name of
    (query, cursor) giving (rows, next cursor or None), importable on the executors; `queries`, a JSON list. Rows are
    (query, body), body being JSON."""

    @classmethod
    def name(cls) -> str:
        return "cursor"

    def schema(self) -> str:
        return "query string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
