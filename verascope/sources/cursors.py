"""Captured pages that name their successors, as a stream whose offsets are the cursors.

A page lies under path/cursor=<its cursor>; its body holds the next page's cursor, or none on the last. A batch goes from page to
page until one isn't there yet, a batch's pages are read, or the cap of records is reached. The offset is the cursor that
comes next, so a restart asks for no page twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

NAME = "cursor_pages"


def _at(value, path: str):
    """What lies at a dotted path of parsed JSON; None if anything on the way is missing."""
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.next, self.items = options["path"], options["next"], options.get("items", "")
        self.start, self.most, self.cap = options.get("start", "first"), int(options.get("maxpagesperbatch", 100)), int(options.get("cap", 0))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": self.start, "pages": 0, "records": 0}

    def _page(self, cursor: str) -> str | None:
        """A page's body, once its writer has finished it."""
        system, folder = fs.FileSystem.from_uri(f"{self.path.rstrip('/')}/cursor={cursor}")
        if system.get_file_info(folder).type != fs.FileType.Directory:
            return None
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        return b"".join(system.open_input_stream(f).read() for f in files).decode("utf-8", "replace") or None

    def _walk(self, at: dict, most: int) -> tuple[list[tuple], dict]:
        rows = []
        while at["cursor"] is not None and len(rows) < most and not (self.cap and at["records"] >= self.cap):
            body = self._page(at["cursor"])
            if body is None:
                break
            try:
                page = json.loads(body)
            except ValueError:  # a page that cannot be read names no successor: the walk ends there
                page = None
            found = _at(page, self.items) if self.items else None
            rows.append((at["cursor"], at["pages"], body))
            following = _at(page, self.next)
            at = {"cursor": str(following) if following not in (None, "") else None, "pages": at["pages"] + 1, "records": at["records"] + (len(found) if isinstance(found, list) else 0)}
        return rows, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._walk(start, self.most)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The pages of a batch that is run again."""
        return iter(self._walk(start, end["pages"] - start["pages"])[0])

    def commit(self, end: dict) -> None:
        pass


class CursorPages(DataSource):
    """Options: path, next (dotted path of the next cursor in a body), items (of the records, for the cap), start, maxPagesPerBatch, cap."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "cursor string, number int, body string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Reader(self.options)


def cursor_pages(spark: SparkSession, path: str, following: str, items: str = "", start: str = "first", cap: int | None = None, per_batch: int = 100) -> DataFrame:
    """A stream (cursor, number, body) of captured pages. The page that reaches the cap of records is the last, and is whole.

    The driver walks the pages, as each names the next; a batch has per_batch of them at most. Parsers of bodies
    (sources.payloads) take the stream as they take a table.
    """
    spark.dataSource.register(CursorPages)
    options = {"next": following, "items": items, "start": start, "cap": str(cap or 0), "maxPagesPerBatch": str(per_batch)}
    return spark.readStream.format(NAME).options(**options).load(path)


def take_all(stream: DataFrame, write, checkpoint: str) -> None:
    """Batches of a stream of pages until none is left. (The available-now trigger takes one batch of such a source.)"""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages (cursor, body) to where cursor_pages() finds them; a body is one line."""
    pages.select("cursor", F.translate("body", "\r\n", "  ").alias("value")).write.mode("append").partitionBy("cursor").text(path)
