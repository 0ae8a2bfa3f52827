"""Rows that a service gives page by page, as a Spark data source.

``spark.read.format("paged_rows")`` asks a service (or files that hold its
answers) for pages of JSON, ``{"rows": [{"row_idx": 5, "row": {..}}, ..]}``.
Pages are dealt out over tasks; a page that fails is asked again with growing
pauses, and one that stays away or holds other rows than were asked for fails
its task, so that no row is lost in silence.  Bounds on ``row_idx`` are pushed
down: pages outside them are never asked for.

Options: ``url`` with ``{offset}``, ``{length}`` or ``{page}`` in it, for http(s)
or any store that pyarrow opens, where a folder stands for the files in it;
``total`` rows; ``page_size`` (100), ``pages_per_task`` (10), ``tries`` (5) and
``pause_s`` (1), which doubles with each try.  The schema is the caller's and
has ``row_idx`` as a long, if that is wanted.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

INDEX = "row_idx"


@dataclass
class Pages(InputPartition):
    """Pages ``first`` to ``last``, without the last."""

    first: int
    last: int


def fetched(url: str) -> bytes:
    """What stands at ``url``: an answer, a file, or the first file with content of a folder."""
    if url.startswith(("http://", "https://")):
        with urllib.request.urlopen(url, timeout=120) as answer:
            return answer.read()
    fs, path = pafs.FileSystem.from_uri(url)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        path = next(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.size and not f.base_name.startswith(("_", ".")))
    with fs.open_input_stream(path) as f:
        return f.read()


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.url, self.total = schema, options["url"], int(options["total"])
        self.page_size, self.per_task = int(options.get("page_size", 100)), int(options.get("pages_per_task", 10))
        self.tries, self.pause = int(options.get("tries", 5)), float(options.get("pause_s", 1))
        self.least, self.most = 0, self.total - 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            whole = getattr(f, "attribute", None) == (INDEX,) and isinstance(getattr(f, "value", None), int)
            if whole and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            if whole and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.most = min(self.most, f.value - isinstance(f, LessThan))
            yield f  # pages hold whole ranges, so Spark still looks at every row

    def partitions(self) -> list[Pages]:
        first, last = self.least // self.page_size, self.most // self.page_size + 1
        return [Pages(k, min(k + self.per_task, last)) for k in range(first, last, self.per_task)] or [Pages(0, 0)]

    def page(self, number: int) -> list[dict]:
        offset = number * self.page_size
        length = min(self.page_size, self.total - offset)
        url, last = self.url.format(offset=offset, length=length, page=number), None
        for k in range(self.tries):
            try:
                rows = json.loads(fetched(url))["rows"]
                if sorted(r[INDEX] for r in rows) != list(range(offset, offset + length)):
                    raise ValueError(f"{url} has other rows than {offset} to {offset + length - 1}")
                return rows
            except (OSError, ValueError, KeyError, StopIteration) as e:
                last = e
                if k + 1 < self.tries:
                    time.sleep(self.pause * 2**k)
        raise RuntimeError(f"no page at {url} in {self.tries} tries") from last

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        made = to_arrow_schema(self.schema)
        for number in range(partition.first, partition.last):
            rows = [{**r["row"], INDEX: r[INDEX]} for r in self.page(number)]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in made.names} for r in rows], schema=made)


class PagedRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))


def paged_rows(spark: SparkSession, url: str, schema: str, total: int, **options) -> DataFrame:
    """The rows of all pages; see the module for the options."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(PagedRows)
    return spark.read.format("paged_rows").schema(schema).options(url=url, total=total, **options).load()
