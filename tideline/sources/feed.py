"""Live feeds as Python data sources: snapshots by offset, and member lists by cursor.

A feed is a small class of two calls; the data sources turn it into partitions for tasks and,
for snapshots, into a stream that restarts where its checkpoint says. `FolderFeed` and
`FolderMembers` serve files, as tests and recorded days need; a vendor's client has the same
calls.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# The fields of a vendor's snapshot.
SNAPSHOT = "code string, close double, amount double, open double, high double, low double, pre_close double, date string"
MEMBER = "index_code string, updateDate string, code string, code_name string"


class Feed(Protocol):
    """Snapshots numbered from 0; what a number stands for never changes."""

    def latest(self) -> int:
        """How many snapshots there are."""

    def read(self, number: int) -> list[dict]:
        """The quotes of a snapshot, by field."""


class Members(Protocol):
    """Member lists of indices, page by page."""

    def indices(self) -> list[str]:
        """Codes of the indices."""

    def page(self, index: str, cursor: str | None) -> tuple[list[dict], str | None]:
        """Members from a cursor on (None: from the first), and the cursor of the next page (None: there is none)."""


class FolderFeed:
    """Snapshots as files <number>.json of a shared folder, each a list of quotes; a writer must move whole files in."""

    def __init__(self, path: str) -> None:
        self.path = path

    def latest(self) -> int:
        numbers = {int(n[:-5]) for n in os.listdir(self.path) if n.endswith(".json") and n[:-5].isdigit()}
        n = 0
        while n in numbers:
            n += 1
        return n

    def read(self, number: int) -> list[dict]:
        with open(f"{self.path}/{number}.json") as file:
            return json.load(file)


class FolderMembers:
    """Member lists as files <index>.json of a shared folder, served in pages."""

    def __init__(self, path: str, size: int = 100) -> None:
        self.path, self.size = path, size

    def indices(self) -> list[str]:
        return sorted(n[:-5] for n in os.listdir(self.path) if n.endswith(".json"))

    def page(self, index: str, cursor: str | None) -> tuple[list[dict], str | None]:
        with open(f"{self.path}/{index}.json") as file:
            members = json.load(file)
        start = int(cursor or 0)
        return members[start : start + self.size], str(start + self.size) if start + self.size < len(members) else None


def _row(record: dict, fields: list[T.StructField]) -> tuple:
    """A record's values by field; those that are missing or no number where one is due are null."""
    out = []
    for f in fields:
        value = record.get(f.name)
        if isinstance(f.dataType, T.DoubleType):
            try:
                value = None if value is None or value == "" else float(value)
            except (TypeError, ValueError):
                value = None
        out.append(value if value is None or isinstance(value, float) else str(value))
    return tuple(out)


class _Numbers(InputPartition):
    def __init__(self, first: int, stop: int) -> None:
        self.first, self.stop = first, stop


def _ranges(first: int, stop: int, size: int) -> list[_Numbers]:
    # Without a partition Spark would call read with none.
    return [_Numbers(i, min(i + size, stop)) for i in range(first, stop, size)] or [_Numbers(first, first)]


class _SnapshotRead:
    def __init__(self, feed: Feed, fields: list[T.StructField], size: int) -> None:
        self.feed, self.fields, self.size = feed, fields, size

    def read(self, partition: _Numbers) -> Iterator[tuple]:
        for number in range(partition.first, partition.stop):
            for record in self.feed.read(number):
                yield (number, *_row(record, self.fields))


class _SnapshotReader(_SnapshotRead, DataSourceReader):
    def partitions(self) -> list[_Numbers]:
        return _ranges(0, self.feed.latest(), self.size)


class _SnapshotStream(_SnapshotRead, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        return {"number": self.feed.latest()}

    def partitions(self, start: dict, end: dict) -> list[_Numbers]:
        return _ranges(start["number"], end["number"], self.size)

    def commit(self, end: dict) -> None:
        pass


def snapshot_source(feed: Feed, name: str = "snapshots", size: int = 8) -> type[DataSource]:
    """A data source of a feed's quotes, with the number of their snapshot; a task reads up to `size` snapshots."""
    quotes = T._parse_datatype_string(SNAPSHOT).fields

    class Snapshots(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"number long, {SNAPSHOT}"

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _SnapshotReader(feed, quotes, size)

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return _SnapshotStream(feed, quotes, size)

    return Snapshots


class _Index(InputPartition):
    def __init__(self, index: str) -> None:
        self.index = index


class _MemberReader(DataSourceReader):
    def __init__(self, members: Members, fields: list[T.StructField]) -> None:
        self.members, self.fields = members, fields

    def partitions(self) -> list[_Index]:
        return [_Index(i) for i in self.members.indices()]

    def read(self, partition: _Index | None) -> Iterator[tuple]:
        if partition is None:  # there are no indices
            return
        cursor = None
        while True:
            page, after = self.members.page(partition.index, cursor)
            for record in page:
                yield (partition.index, *_row(record, self.fields))
            if after is None:
                return
            if after == cursor:
                raise RuntimeError(f"the cursor of {partition.index} doesn't move on from {cursor}")
            cursor = after


def member_source(members: Members, name: str = "members") -> type[DataSource]:
    """A data source of the members of all indices: a task walks through the pages of one."""
    fields = T._parse_datatype_string(MEMBER).fields[1:]

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return MEMBER

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _MemberReader(members, fields)

    return Listing


def read_feed(spark: SparkSession, feed: Feed, name: str = "snapshots") -> DataFrame:
    """All snapshots so far."""
    spark.dataSource.register(snapshot_source(feed, name))
    return spark.read.format(name).load()


def stream_feed(spark: SparkSession, feed: Feed, name: str = "snapshots") -> DataFrame:
    """A stream of snapshots from the first one, or from where a query's checkpoint has got to."""
    spark.dataSource.register(snapshot_source(feed, name))
    return spark.readStream.format(name).load()


def read_members(spark: SparkSession, members: Members, name: str = "members") -> DataFrame:
    """index_code, updateDate, code, code_name of all members of all indices."""
    spark.dataSource.register(member_source(members, name))
    return spark.read.format(name).load()
