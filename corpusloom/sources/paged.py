"""A data source over a paged row service: one partition a contiguous range of rows.

``spark.read.format("paged_rows").option("total", n).option("page", 100).option("source", "module:function")``:
the function takes ``(offset, length)`` and returns that many rows as dictionaries; it is called again with
growing pauses when it raises, and a page of another length or order is an error.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Page(InputPartition):
    def __init__(self, offset: int, length: int):
        super().__init__((offset, length))
        self.offset, self.length = offset, length


class PagedRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "row_index long, content string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.total = int(options["total"])
        self.page = min(int(options.get("page", 100)), 100)
        self.source = options["source"]
        self.attempts = int(options.get("attempts", 5))
        self.pause = float(options.get("pause", 0.5))

    def partitions(self) -> list[Page]:
        return [Page(k, min(self.page, self.total - k)) for k in range(0, self.total, self.page)]

    def read(self, partition: Page) -> Iterator[tuple[int, str]]:
        module, _, function = self.source.partition(":")
        fetch = getattr(importlib.import_module(module), function)
        for attempt in range(self.attempts):
            try:
                rows = fetch(partition.offset, partition.length)
                break
            except OSError:
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(self.pause * 2**attempt)
        if [r["row_index"] for r in rows] != list(range(partition.offset, partition.offset + partition.length)):
            raise ValueError(f"rows {partition.offset} to {partition.offset + partition.length - 1}: another range came back")
        for r in rows:
            yield r["row_index"], r["content"]
