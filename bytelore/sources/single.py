"""Sources and sinks of one file that many tasks read or write: members of a zip file, and text between a head and a foot.

`spark.read.format("zip_members").load(path)` has a partition for each range of a zip file's directory. The sinks write a part
in each task, in the order of the partitions, and the commit joins the parts into the file, in pieces; an abort, or a task that
is tried again, leaves nothing at the target. Joining is one stream of bytes, as one file is.
"""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from bytelore.sources import store, zips

MEMBERS = "ord bigint, name string, size bigint, content binary"


#: Members of a batch at most, bytes after which it ends; partitions at most, each with more ranges in a file with more members.
BATCH_MEMBERS, BATCH_BYTES, PARTITIONS = 500, 1 << 23, 1024


@dataclass
class Range(InputPartition):
    before: int
    at: int
    n: int


@dataclass
class Ranges(InputPartition):
    """Neighbouring ranges."""

    parts: list[Range]


@dataclass
class Part(WriterCommitMessage):
    number: int
    uri: str


class ZipReader(DataSourceReader):
    """Regular members (folders are left out), in the order of the directory; `ord` counts them."""

    def __init__(self, path: str, members_each: int):
        self.path, self.each = path, members_each

    def partitions(self) -> list[InputPartition]:
        """The directory is read as a stream; of each range only its place is held."""
        out, before = [], 0
        with store.opened(self.path) as f:
            for k, (at, e) in enumerate(zips.entries(f, zips.directory(f))):
                if k % self.each == 0:
                    out.append(Range(before, at, 0))
                out[-1].n += 1
                before += not e.name.endswith("/")
        each = -(-len(out) // PARTITIONS) or 1
        return [Ranges(out[k : k + each]) for k in range(0, len(out), each)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        if not partition.parts:
            return
        with store.opened(self.path) as f:
            found, some, load = zips.directory(f), [], 0
            for part in partition.parts:
                number = part.before
                for _, e in list(zips.entries(f, found, part.at, part.n)):
                    if e.name.endswith("/"):
                        continue
                    some.append((number, e.name, e.size, b"".join(zips.pieces(f, e)) if e.size else b""))
                    number, load = number + 1, load + e.size
                    if len(some) >= BATCH_MEMBERS or load >= BATCH_BYTES:
                        yield _members_batch(some)
                        some, load = [], 0
            if some:
                yield _members_batch(some)


def _members_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["ord", "name", "size", "content"])


class _Writer(DataSourceArrowWriter):
    """Parts beside the target, joined by the commit."""

    def __init__(self, path: str, options: dict):
        self.path, self.options = path, options
        self.folder = f"{os.path.dirname(path.rstrip('/'))}/.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        uri = f"{self.folder}/{uuid.uuid4().hex}"
        with store.created(uri) as out:
            self.write_part(iterator, out)
        return Part(TaskContext.get().partitionId(), uri)

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m.uri for m in sorted((m for m in messages if m is not None), key=lambda m: m.number)]
        made = f"{self.folder}/{uuid.uuid4().hex}"
        self.join(parts, made)
        store.moved(made, self.path)
        store.deleted(self.folder)

    def abort(self, messages: list[Part | None]) -> None:
        store.deleted(self.folder)


class ZipWriter(_Writer):
    def write_part(self, iterator, out) -> None:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in iterator:
                for row in batch.select(["name", "content"]).to_pylist():
                    z.writestr(zipfile.ZipInfo(row["name"]), row["content"] or b"", zipfile.ZIP_DEFLATED)

    def join(self, parts: list[str], target: str) -> None:
        zips.joined(parts, target)


class TextWriter(_Writer):
    """Values of a column, a line each, between the options `head` and `foot`."""

    def write_part(self, iterator, out) -> None:
        for batch in iterator:
            for value in batch.column("value").to_pylist():
                out.write((value or "").encode() + b"\n")

    def join(self, parts: list[str], target: str) -> None:
        with store.created(target) as out:
            out.write(f"{self.options['head']}\n".encode() if self.options.get("head") else b"")
            for uri in parts:
                with store.opened(uri) as f:
                    while piece := f.read(zips.PIECE):
                        out.write(piece)
            out.write(f"{self.options['foot']}\n".encode() if self.options.get("foot") else b"")


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options["path"], int(self.options.get("memberseach", "1000")))

    def writer(self, schema, overwrite: bool) -> ZipWriter:
        return ZipWriter(self.options["path"], dict(self.options))


class SingleText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "single_text"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> TextWriter:
        return TextWriter(self.options["path"], dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipMembers)
    spark.dataSource.register(SingleText)


def read_zip(spark: SparkSession, path: str, members_each: int = 1000) -> DataFrame:
    """(ord, name, size, content) of the members of a zip file, dealt to tasks by ranges."""
    register(spark)
    return spark.read.format("zip_members").option("membersEach", members_each).load(path)


def write_zip(df: DataFrame, path: str) -> None:
    """One zip file with a member for each row (name, content), in the order of the partitions and of their rows."""
    register(df.sparkSession)
    df.select("name", "content").write.format("zip_members").mode("append").save(path)


def write_text(df: DataFrame, path: str, head: str = "", foot: str = "") -> None:
    """One text file with a line for each row (value), in the order of the partitions and of their rows."""
    register(df.sparkSession)
    df.select("value").write.format("single_text").option("head", head).option("foot", foot).mode("append").save(path)
