"""Posting dumps as a data source of their own, ``format("posting_dump")`` for batch and stream.

A dump is a folder of JSON Lines files that a collector adds to. Every file is one input partition,
read on an executor. Equality and membership tests on the columns are pushed into the reader, so rows
they exclude never leave Python. As a stream, the offset is the last file seen in the order of
(modification time, name); files that appear later have later times, so each is read once.

The folder must be mounted on driver and executors (a path or a ``file:`` URI): Python reads the files
itself. Other stores are read by ``sources/files.read_json``. A line that is no JSON object is left out,
or fails the read with ``mode=FAILFAST``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from jobsmith.functions import fixed

ROWS = 5_000


def _folder(path: str | None) -> str:
    if not path:
        raise ValueError("posting_dump needs a path")
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"posting_dump reads mounted folders only, not {at.scheme}:")
    return unquote(at.path) if at.scheme else path


def _files(folder: str) -> list[tuple[int, str]]:
    """(modification time, path) of the dump's files, in the order of a stream; a missing folder is an empty dump."""
    found = []
    for at, _, names in os.walk(folder):
        if any(part.startswith(("_", ".")) for part in os.path.relpath(at, folder).split(os.sep) if part != "."):
            continue
        for name in names:
            if not name.startswith(("_", ".")):
                path = os.path.join(at, name)
                found.append((os.stat(path).st_mtime_ns, path))
    return sorted(found)


class File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Lines:
    """Reads files into batches of the schema's columns, all as strings."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.names = schema.names
        self.strict = options.get("mode", "").upper() == "FAILFAST"
        self.folder = _folder(options.get("path"))
        self.wanted: dict[str, set] = {}

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty dump has one partition without a file
            return
        held: list[list] = []
        with open(partition.path, encoding="utf-8") as lines:
            for line in lines:
                try:
                    record = json.loads(line)
                    if not isinstance(record, dict):
                        raise ValueError("no JSON object")
                except ValueError:
                    if self.strict:
                        raise
                    continue
                row = [v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in map(record.get, self.names)]
                if all(row[self.names.index(c)] in values for c, values in self.wanted.items()):
                    held.append(row)
                if len(held) >= ROWS:
                    yield self._batch(held)
                    held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=self.names)


class DumpReader(_Lines, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - the interface's name
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or not all(isinstance(v, str) for v in values):
                yield f  # left to Spark
            else:
                column = f.attribute[0]
                self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self) -> list[File]:
        return [File(path) for _, path in _files(self.folder)]


class DumpStream(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _files(self.folder)
        return dict(zip(("time", "path"), files[-1])) if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[File]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return [File(path) for time, path in _files(self.folder) if after < (time, path) <= upto]


class PostingDump(DataSource):
    """``format("posting_dump")``; option ``columns`` (comma-separated) replaces the nine posting columns."""

    @classmethod
    def name(cls) -> str:
        return "posting_dump"

    def schema(self) -> StructType:
        names = self.options.get("columns", ",".join(fixed.POSTING_9)).split(",")
        return StructType([StructField(n.strip(), StringType()) for n in names])

    def reader(self, schema: StructType) -> DumpReader:
        return DumpReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DumpStream:  # noqa: N802
        return DumpStream(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PostingDump)


def read_dump(spark: SparkSession, path: str, columns: tuple[str, ...] = tuple(fixed.POSTING_9)) -> DataFrame:
    register(spark)
    return spark.read.format("posting_dump").option("columns", ",".join(columns)).load(path)


def stream_dump(spark: SparkSession, path: str, sink: str, checkpoint: str, columns: tuple[str, ...] = tuple(fixed.POSTING_9)) -> None:
    """Adds what is new in the dump to a Parquet folder, and returns when all of it is there."""
    register(spark)
    rows = spark.readStream.format("posting_dump").option("columns", ",".join(columns)).load(path)
    query = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
