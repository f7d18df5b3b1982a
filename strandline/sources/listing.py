"""Listings of folders as a data source: names are dealt out by their first letters, and listed in batches by tasks.

For file systems that Python's ``os`` reaches on every executor (local to all, or mounted on all); other stores are listed by ``readers``.

    spark.dataSource.register(ListingSource)
    spark.read.format("listing").option("path", folder).option("prefixes", "0123456789abcdef.").load()
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Entries that a task holds at once, and the first letters that names are dealt out by, unless told otherwise.
BATCH, PREFIXES = 128, "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ._-"


class Prefix(InputPartition):
    """Names that begin with one of some letters; with ``rest``, those that begin with none of them."""

    def __init__(self, letters: str, rest: bool):
        super().__init__((letters, rest))
        self.letters, self.rest = letters, rest


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.prefixes = options.get("prefixes", PREFIXES)
        self.tasks = int(options.get("tasks", 8))

    def partitions(self) -> list[Prefix]:
        dealt = [self.prefixes[k :: self.tasks] for k in range(self.tasks)]
        return [Prefix(x, False) for x in dealt if x] + [Prefix(self.prefixes, True)]

    def read(self, partition: Prefix) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        with os.scandir(self.path) as entries:
            for e in entries:
                if (e.name[0] in partition.letters) == partition.rest or not e.is_file(follow_symlinks=False):
                    continue
                try:
                    s = e.stat(follow_symlinks=False)
                except FileNotFoundError:  # it went while the folder was read
                    continue
                held.append((e.name, s.st_size, s.st_mtime_ns // 1_000_000))
                if len(held) == BATCH:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, sizes, times = zip(*rows, strict=True)
    return pa.record_batch([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(times, pa.int64())], names=["name", "bytes", "modified_ms"])


class ListingSource(DataSource):
    """(name, bytes, modified_ms) of the files of a folder, hidden ones too; folders and links are left out."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "name string, bytes long, modified_ms long"

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(self.options)


def listing(spark: SparkSession, folder: str, tasks: int = 8, prefixes: str = PREFIXES):
    """The listing of a folder; nothing of it reaches the driver."""
    spark.dataSource.register(ListingSource)
    return spark.read.format("listing").option("path", folder).option("tasks", tasks).option("prefixes", prefixes).load()
