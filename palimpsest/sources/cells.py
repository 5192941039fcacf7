"""A data source over cells in Parquet, one partition for each slice, in batch and as a stream.

    spark.dataSource.register(CellSource)
    spark.read.format("cells").option("path", p).option("nslices", 8).option("since", t0).load()
    spark.readStream.format("cells").option("path", p).option("nslices", 8).load()

Slices are disjoint and together complete. A batch read covers commit times in (since, until];
each micro-batch of a stream covers the times after the last one's. The files are read through
pyarrow's dataset layer on the executors, which prunes row groups by time. Where the path lies in
a file system that only Spark reads, use ``spark.read.parquet`` and ``palimpsest.operators.scan``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from palimpsest.model import MAX_TIME, MIN_TIME

SCHEMA = "key bigint, time bigint, value double"


@dataclass
class Slice(InputPartition):
    index: int
    count: int
    since: int
    until: int


def read_slice(path: str, part: Slice) -> Iterator:
    """The slice's cells, as Arrow batches."""
    wanted = (pc.field("time") > part.since) & (pc.field("time") <= part.until) & (pc.bit_wise_and(pc.field("key"), part.count - 1) == part.index)
    for batch in ds.dataset(path, format="parquet").to_batches(columns=["key", "time", "value"], filter=wanted):
        if batch.num_rows:
            yield batch


class CellReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.count = options["path"], int(options.get("nslices", 1))
        if self.count < 1 or self.count & (self.count - 1):
            raise ValueError("nslices must be a power of two")
        self.since, self.until = int(options.get("since", MIN_TIME - 1)), int(options.get("until", MAX_TIME))
        if self.since > self.until:
            raise ValueError("since is after until")

    def partitions(self) -> list[Slice]:
        return [Slice(i, self.count, self.since, self.until) for i in range(self.count)]

    def read(self, partition: Slice) -> Iterator:
        return read_slice(self.path, partition)


class CellStreamReader(DataSourceStreamReader):
    """Offsets are commit times: a batch covers the times after its start, up to its end."""

    def __init__(self, options: dict):
        self.path, self.count = options["path"], int(options.get("nslices", 1))
        self.first = int(options.get("since", MIN_TIME - 1))

    def initialOffset(self) -> dict:
        return {"time": self.first}

    def latestOffset(self) -> dict:
        newest = max((pc.max(b.column("time")).as_py() for b in ds.dataset(self.path, format="parquet").to_batches(columns=["time"]) if b.num_rows), default=self.first)
        return {"time": newest}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return [Slice(i, self.count, start["time"], end["time"]) for i in range(self.count)]

    def read(self, partition: Slice) -> Iterator:
        return read_slice(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class CellSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CellReader:
        return CellReader(self.options)

    def streamReader(self, schema) -> CellStreamReader:
        return CellStreamReader(self.options)
