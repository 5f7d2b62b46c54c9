"""A paged source: one input partition per page of a numbered JSON-lines folder."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedJson(DataSource):
    """``spark.read.format("paged_json").option("template", "/data/page-{n}.json").option("pages", 3)``.

    Rows: page, position, item. A page that is missing ends nothing: it has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, position int, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.template, self.pages, self.items = options["template"], int(options["pages"]), options.get("items", "items")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in range(1, self.pages + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, int, str]]:
        try:
            with open(self.template.replace("{n}", str(partition.value)), encoding="utf-8") as f:
                document = json.load(f)
        except FileNotFoundError:
            return
        for i, item in enumerate(document.get(self.items) or []):
            yield partition.value, i, json.dumps(item, sort_keys=True, ensure_ascii=False)
