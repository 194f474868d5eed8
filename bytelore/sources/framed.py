"""Framed streams of objects in a file: as a table, and as a stream whose offsets are bytes.

Each object follows lines `name: value`, one of them `content-length: n`, and an empty line. Frames are found by reading their
heads and seeking over what they hold, so tasks get ranges of frames. As a stream, an offset is the end of a whole frame: a
query that is started again from its checkpoint goes on with the next one, and a frame that is not whole yet waits.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from bytelore import schema
from bytelore.sources import store

OBJECTS = "object_id string, filename string, size bigint, bof binary, eof binary, extension_of string"


def length_of(f: BinaryIO) -> tuple[int, int]:
    """(bytes of the head, bytes of the object) at the place of a stream; an object of -1 bytes if there is no head, or none that says it."""
    head, n = 0, -1
    while line := f.readline():
        head += len(line)
        if not line.strip():
            return head, n
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            n = int(value)
    return head, -1


def frames(f: BinaryIO, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """(place of the object, its bytes) of the whole frames from a place on, up to another; nothing of the objects is read."""
    end = f.seek(0, os.SEEK_END) if end is None else end
    while at < end:
        f.seek(at)
        head, n = length_of(f)
        if n < 0 or at + head + n > end:
            return
        yield at + head, n
        at += head + n


@dataclass
class Range(InputPartition):
    at: int
    end: int


class _Frames:
    def __init__(self, options: dict):
        self.path, self.each, self.size = options["path"], int(options.get("frameseach", "1000")), int(options.get("bufsize", str(schema.BUFFER)))

    def ranges(self, at: int, end: int | None = None) -> list[Range]:
        out: list[Range] = []
        with store.opened(self.path) as f:
            for k, (place, n) in enumerate(frames(f, at, end)):
                if k % self.each == 0:
                    out.append(Range(at if not out else out[-1].end, 0))
                out[-1].end = place + n
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with store.opened(self.path) as f:
            for place, n in list(frames(f, partition.at, partition.end)):
                f.seek(place)
                first = f.read(min(n, self.size))
                f.seek(place + max(0, n - self.size))
                last = f.read(min(n, self.size))
                name = f"STDIN!(at {place} bytes)"
                columns = [pa.array([x], t) for x, t in ((name, pa.string()), (name, pa.string()), (n, pa.int64()), (first, pa.binary()), (last, pa.binary()), (name, pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["object_id", "filename", "size", "bof", "eof", "extension_of"])


class FramedReader(_Frames, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.ranges(0) or [Range(0, 0)]


class FramedStreamReader(_Frames, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.seen = 0  # the end of the last whole frame that was found

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        with store.opened(self.path) as f:
            for place, n in frames(f, self.seen):
                self.seen = place + n
        return {"at": self.seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.ranges(start["at"], end["at"])

    def commit(self, end: dict) -> None:
        pass


class FramedObjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framed_objects"

    def schema(self) -> str:
        return OBJECTS

    def reader(self, schema) -> FramedReader:
        return FramedReader(dict(self.options))

    def streamReader(self, schema) -> FramedStreamReader:
        return FramedStreamReader(dict(self.options))


def read_frames(spark: SparkSession, path: str, size: int = schema.BUFFER, frames_each: int = 1000) -> DataFrame:
    """Objects of a framed stream in a file, named by their offsets, by ranges; two windows of each are read."""
    spark.dataSource.register(FramedObjects)
    return spark.read.format("framed_objects").option("bufsize", size).option("framesEach", frames_each).load(path)


def stream_frames(spark: SparkSession, path: str, size: int = schema.BUFFER, frames_each: int = 1000) -> DataFrame:
    """The same as a stream, which goes on as the file grows."""
    spark.dataSource.register(FramedObjects)
    return spark.readStream.format("framed_objects").option("bufsize", size).option("framesEach", frames_each).load(path)
