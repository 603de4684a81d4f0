"""Listings read page by page as a stream: a Python data source whose offset is the cursor of each work.

A page that was landed for a work at a cursor is the file ``<work, quoted>.<cursor>.json`` of one folder. The next page's
cursor is the ``order`` of the last item, or else the cursor plus the size of a page; a page with fewer items is the
last. Runs of pages are partitions, so pages are read by the executors; the driver reads each page once, for its cursor,
several works at a time.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quire.sources.uri import located

PAGE_SIZE = 30
#: Works of one stream at most, as its offset names each of them.
MAX_WORKS = 10_000
#: Pages of a partition at least, and partitions of a batch at most, from which on they grow.
TASK_PAGES, TASKS = 64, 200
#: Works whose pages the driver reads at a time.
READERS = 16
#: The cursor of a work that has been read to its end.
END = -1


def page_name(work: str, cursor: int) -> str:
    return f"{quote(work, safe='')}.{cursor}.json"


def items_of(page: str) -> list[dict]:
    """The items of a page in either body shape; none for an error or unreadable JSON."""
    try:
        body = json.loads(page).get("body") or {}
        found = body.get("seriesContents") or (body.get("page") or {}).get("seriesContents") or []
    except (ValueError, AttributeError):
        return []
    return [x for x in found if isinstance(x, dict)]


def next_cursor(cursor: int, page: str, size: int = PAGE_SIZE) -> int:
    """Where the listing goes on behind a page, END behind the last; a cursor that does not advance is the last too."""
    items = items_of(page)
    if len(items) < size:
        return END
    try:
        after = int(items[-1].get("order") or cursor + size)
    except (TypeError, ValueError):
        after = cursor + size
    return after if after > cursor else END


@dataclass
class _Run(InputPartition):
    pages: list[tuple[str, int, int]]  # work, number, cursor


class _Pages(DataSourceStreamReader):
    def __init__(self, path: str, works: list[str], size: int):
        self.path, self.works, self.size = path, works, size
        #: work -> cursors of its pages that have landed, and behind them where it goes on
        self.chains: dict[str, list[int]] = {w: [0] for w in works}

    def _read(self, work: str, cursor: int) -> str | None:
        store, base = located(self.path)
        try:
            with store.open_input_stream(f"{base}/{page_name(work, cursor)}") as f:
                return f.read().decode("utf-8", "replace")
        except FileNotFoundError:
            return None

    def _advance(self, work: str) -> list[int]:
        chain = self.chains[work]
        while chain[-1] != END and (page := self._read(work, chain[-1])) is not None:
            chain.append(next_cursor(chain[-1], page, self.size))
        return chain

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """work -> number of its pages that have landed, for those with any."""
        return {w: n for w, chain in self._advanced(self.works) if (n := len(chain) - 1)}

    def _advanced(self, works: list[str]) -> list[tuple[str, list[int]]]:
        with ThreadPoolExecutor(READERS) as pool:
            return list(zip(works, pool.map(self._advance, works)))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        pages = [(work, k, chain[k]) for work, chain in self._advanced(list(end)) for k in range(start.get(work, 0), end[work])]
        size = max(TASK_PAGES, -(-len(pages) // TASKS))
        return [_Run(pages[k : k + size]) for k in range(0, len(pages), size)]

    def read(self, partition: _Run):
        for work, number, cursor in partition.pages:
            page = self._read(work, cursor)
            if page is None:
                raise FileNotFoundError(page_name(work, cursor))
            yield (work, number, cursor, page)

    def commit(self, end: dict) -> None:
        """Nothing is held for pages that are through: the checkpoint has their number."""


class ListingPages(DataSource):
    """Format quire_pages; options path, works (a JSON list of strings) and page_size."""

    @classmethod
    def name(cls) -> str:
        return "quire_pages"

    def schema(self) -> str:
        return "work_id string, page_no long, cursor long, json string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        works = list(dict.fromkeys(json.loads(self.options["works"])))
        if len(works) > MAX_WORKS:
            raise ValueError(f"a stream pages at most {MAX_WORKS} works")
        return _Pages(self.options["path"], works, int(self.options.get("page_size", PAGE_SIZE)))


def stream_pages(spark: SparkSession, path: str, works: list[str], page_size: int = PAGE_SIZE) -> DataFrame:
    """(work_id, page_no, cursor, json) as a stream of the pages that land in a folder, each once and in the order of their cursors."""
    spark.dataSource.register(ListingPages)
    return spark.readStream.format("quire_pages").option("path", path).option("works", json.dumps(works)).option("page_size", str(page_size)).load()
