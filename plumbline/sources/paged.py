"""Events that come in pages, as a data source of Spark: key ranges in parallel, each read page after page until a short one.

A service hands out rows of a key range newest first, so many at a time; the page that is not full is the last. Here the pages are
JSON files, `low=<first id>/page=<number>`, as a crawler of such a service leaves them. Each key range is one partition. Conditions
on the time are pushed to the reader: a lower bound ends a range with the first page that is older, and rows are
filtered before they reach Spark. A page is the most that a task holds at once.

    spark.dataSource.register(PagedEvents)
    spark.read.format("paged_events").option("page_rows", 1000).load(path)

Filters are pushed where `spark.sql.python.filterPushdown.enabled` is set; without it Spark filters.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, json as pa_json
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from plumbline.schemas import EVENTS

# Fixed value: rows of a full page.
PAGE_ROWS = 1_000
TIME = pa.timestamp("us", tz="UTC")
SHAPE = pa.schema([(f.name, TIME if f.name == "created_at" else pa.int64() if f.name == "id" else pa.string()) for f in EVENTS.fields])
# How the conditions on the time that are answered here compare.
COMPARE = {GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


@dataclass
class KeyRange(InputPartition):
    folder: str


class PagedReader(DataSourceReader):
    def __init__(self, path: str, page_rows: int):
        self.path, self.page_rows = path, page_rows
        self.conditions: list[tuple[type, datetime]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of the time with a value; hands back the others."""
        for one in filters:
            if type(one) in COMPARE and one.attribute == ("created_at",) and isinstance(one.value, datetime):
                at = one.value if one.value.tzinfo else one.value.replace(tzinfo=timezone.utc)
                self.conditions.append((type(one), at))
            else:
                yield one

    def _system(self) -> tuple[fs.FileSystem, str]:
        # Paths without a scheme are local ones.
        return fs.FileSystem.from_uri(self.path) if re.match(r"[a-z0-9]+:", self.path) else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[KeyRange]:
        system, root = self._system()
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [KeyRange(f.base_name) for f in sorted(found, key=lambda f: f.base_name)
                if f.type == fs.FileType.Directory and f.base_name.startswith("low=")]

    def page(self, folder: str, number: int) -> pa.Table | None:
        """The rows of one page; None where there is no such page."""
        system, root = self._system()
        place = posixpath.join(root, folder, f"page={number}")
        files = [f for f in system.get_file_info(fs.FileSelector(place, allow_not_found=True)) if f.base_name.endswith(".json")]
        if not files:
            return None
        tables = []
        for file in files:
            if file.size:
                with system.open_input_stream(file.path) as stream:
                    tables.append(pa_json.read_json(stream, parse_options=pa_json.ParseOptions(explicit_schema=SHAPE, unexpected_field_behavior="ignore")))
        return pa.concat_tables([t.select(SHAPE.names) for t in tables]) if tables else SHAPE.empty_table()

    def pages(self, folder: str) -> Iterator[pa.Table]:
        """Pages of a key range until a short, missing or too old one."""
        number = 0
        while (rows := self.page(folder, number)) is not None:
            yield rows
            if rows.num_rows < self.page_rows or self._older(rows):
                return
            number += 1

    def _older(self, rows: pa.Table) -> bool:
        """Does the page reach below a lower bound? Then so do all rows behind it."""
        last = pc.min(rows["created_at"]).as_py()
        return last is not None and any(kind in (GreaterThan, GreaterThanOrEqual) and last < at for kind, at in self.conditions)

    def read(self, partition: KeyRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no range at all
            return
        for rows in self.pages(partition.folder):
            for kind, at in self.conditions:
                rows = rows.filter(COMPARE[kind](rows["created_at"], pa.scalar(at, TIME)))
            yield from rows.to_batches()


class PagedEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_events"

    def schema(self) -> StructType:
        return StructType([*EVENTS.fields])

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options["path"], int(self.options.get("page_rows", PAGE_ROWS)))


def read_paged_events(spark: SparkSession, path: str, page_rows: int = PAGE_ROWS) -> DataFrame:
    """All pages of all key ranges; conditions on the time are pushed to the pages."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedEvents)
    return spark.read.format("paged_events").option("page_rows", str(page_rows)).load(path)


def write_pages(events: DataFrame, path: str, range_keys: int, page_rows: int = PAGE_ROWS) -> None:
    """Events as page files. A key range spans `range_keys` ids, which bounds what is sorted together."""
    low = (F.floor(F.col("id") / range_keys) * range_keys).cast("long")
    order = W.partitionBy("low").orderBy(F.desc("created_at"), F.desc("id"))
    numbered = events.select(*EVENTS.fieldNames(), low.alias("low")).withColumn(
        "page", F.floor((F.row_number().over(order) - 1) / page_rows).cast("int"))
    numbered.repartition("low", "page").sortWithinPartitions("low", "page", F.desc("created_at"), F.desc("id")).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).write.partitionBy("low", "page").option(
        "ignoreNullFields", False).json(path)
