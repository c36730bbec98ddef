"""A paged source: the pages of one listing as partitions, read up to the first empty one."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, number: int, onward: bool = False):
        self.number, self.onward = number, onward


class PagedReader(DataSourceReader):
    """One partition for each of the first pages; the last one goes on to the end of the listing, so none is cut. Pages are read
    by the executors, a page beyond the end is empty."""

    def __init__(self, fetch: Callable[[int], Sequence[dict]], columns: list[str], pages: int):
        self.fetch, self.columns, self.pages = fetch, columns, pages

    def partitions(self) -> Sequence[InputPartition]:
        return [Page(n, n == self.pages) for n in range(1, self.pages + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        number = partition.number
        while rows := self.fetch(number):
            for row in rows:
                yield (number, *(row.get(c) for c in self.columns))
            if not partition.onward:
                return
            number += 1


class JsonPages(DataSource):
    """`spark.read.format("json_pages").schema(...)`: options `path` (with {page} in it, in a folder that all executors
    see) and `pages` (how many are read beside each other). Columns beside `page` are texts. A page that is not there is the end."""

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return "page int, id string, title string"

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"]

        def fetch(number: int) -> list[dict]:
            try:
                with open(path.format(page=number), encoding="utf-8") as f:
                    return json.load(f)
            except FileNotFoundError:
                return []

        return PagedReader(fetch, [c for c in schema.names if c != "page"], max(1, int(self.options.get("pages", "50"))))
