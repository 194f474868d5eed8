"""Streams of compound files (the public compound file binary format), read by seeking.

Of the allocation tables only the sectors that a chain passes are read, some of them held; directory entries are read when the
walk comes to them; streams come in pieces. Held whole are the numbers of the table's own sectors (one for 64 thousand bytes of
a file of small sectors) and of the sectors of the mini stream.
"""

from __future__ import annotations

import io
import os
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelore.functions.batches import mapped

SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
END, _LAST = 0xFFFFFFFE, 0xFFFFFFFA  # the end of a chain; the greatest number of a sector
PIECE = 1 << 20


class Entry(NamedTuple):
    name: str
    kind: int  # 1: storage, 2: stream, 5: root
    left: int
    right: int
    child: int
    start: int
    size: int


class CompoundFile:
    def __init__(self, source: bytes | BinaryIO):
        self.f = io.BytesIO(source) if isinstance(source, bytes) else source
        self.length = self.f.seek(0, os.SEEK_END)
        head = self._at(0, 512)
        if head[:8] != SIGNATURE or len(head) < 512:
            raise ValueError("not a compound file")
        shift, self.mini_shift = struct.unpack_from("<HH", head, 30)
        if not (7 <= shift <= 16 and self.mini_shift <= shift):
            raise ValueError("unknown sector size")
        self.size = 1 << shift
        self.wide = shift > 9  # lengths of 64 bits
        (first_dir,) = struct.unpack_from("<I", head, 48)
        self.cutoff, first_mini, _, sector, _ = struct.unpack_from("<IIIII", head, 56)
        self.most = self.length // self.size + 1  # no chain is longer than the file
        self.tables = array("L", (t for t in struct.unpack_from("<109I", head, 76) if t <= _LAST))
        for _ in range(self.most):
            if sector > _LAST:
                break
            more = self._numbers(sector)
            self.tables.extend(t for t in more[:-1] if t <= _LAST)
            sector = more[-1] if more else END
        self._table = lru_cache(64)(self._numbers)
        self.directory = array("L", self._chain(first_dir))
        root = self.entry(0)
        self.mini_tables = array("L", self._chain(first_mini))
        self.mini = array("L", self._chain(root.start))
        self.mini_size = root.size

    def _at(self, place: int, n: int) -> bytes:
        self.f.seek(place)
        return self.f.read(n)

    def _sector(self, n: int) -> bytes:
        return self._at((n + 1) * self.size, self.size)

    def _numbers(self, n: int) -> tuple[int, ...]:
        raw = self._sector(n)
        return struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])

    def _next(self, n: int, tables: array) -> int:
        each = self.size // 4
        if n // each >= len(tables):
            return END
        numbers = self._table(tables[n // each])
        return numbers[n % each] if n % each < len(numbers) else END

    def _chain(self, n: int, mini: bool = False) -> Iterator[int]:
        seen, most = 0, self.most << (self.size.bit_length() - 1 - self.mini_shift) if mini else self.most
        while n <= _LAST and seen < most:
            yield n
            n, seen = self._next(n, self.mini_tables if mini else self.tables), seen + 1

    def entry(self, i: int) -> Entry:
        each = self.size // 128
        if i // each >= len(self.directory):
            raise ValueError("no such directory entry")
        raw = self._at((self.directory[i // each] + 1) * self.size + i % each * 128, 128)
        if len(raw) < 128:
            raise ValueError("directory cut off")
        (named,) = struct.unpack_from("<H", raw, 64)
        left, right, child = struct.unpack_from("<III", raw, 68)
        (start,) = struct.unpack_from("<I", raw, 116)
        (size,) = struct.unpack_from("<Q", raw, 120)
        return Entry(raw[: max(0, min(named, 64) - 2)].decode("utf-16-le", "replace"), raw[66], left, right, child, start, size if self.wide else size & 0xFFFFFFFF)

    def streams(self) -> Iterator[tuple[str, Entry]]:
        """(path, entry) of all streams, in the order of the directory's trees; nothing of them is read."""
        seen: set[int] = set()
        todo = [(self.entry(0).child, "", False)]
        count = len(self.directory) * (self.size // 128)
        while todo:
            i, prefix, ready = todo.pop()
            if i >= count or (i in seen and not ready):
                continue
            e = self.entry(i)
            if not ready:
                seen.add(i)
                todo += [(e.right, prefix, False), (i, prefix, True), (e.left, prefix, False)]
            elif e.kind == 2:
                yield prefix + e.name, e
            elif e.kind == 1:
                todo.append((e.child, f"{prefix}{e.name}/", False))

    def pieces(self, e: Entry) -> Iterator[bytes]:
        left = e.size
        if e.size < self.cutoff:
            unit = 1 << self.mini_shift
            for s in self._chain(e.start, mini=True):
                at = s * unit
                if left <= 0 or at >= self.mini_size or at // self.size >= len(self.mini):
                    return
                yield self._at((self.mini[at // self.size] + 1) * self.size + at % self.size, min(left, unit))
                left -= unit
            return
        first, n = None, 0  # neighbouring sectors are read at once
        for s in self._chain(e.start):
            if first is not None and s == first + n and n * self.size < PIECE:
                n += 1
                continue
            if first is not None:
                yield self._at((first + 1) * self.size, min(left, n * self.size))
                left -= n * self.size
            if left <= 0:
                return
            first, n = s, 1
        if first is not None:
            yield self._at((first + 1) * self.size, min(left, n * self.size))

    def read(self, e: Entry) -> bytes:
        return b"".join(self.pieces(e))


def streams_of(df: DataFrame, object_id: str = "object_id", content: str = "content") -> DataFrame:
    """(object_id, path, size, content) of the streams of compound files in a binary column; what is no compound file, or damaged, has those before the damage."""

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = []
                try:
                    whole = CompoundFile(data or b"")
                    for path, e in whole.streams():
                        out.append((key, path, e.size, whole.read(e)))
                except (ValueError, struct.error):
                    pass
                columns = list(zip(*out, strict=True)) or [()] * 4
                types = (pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["object_id", "path", "size", "content"])

    rows = df.select(F.col(object_id).cast("string").alias("object_id"), F.col(content).alias("content"))
    return mapped(rows, run, "object_id string, path string, size long, content binary")
