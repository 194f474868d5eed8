"""Members of zip and tar files by byte range: an index of an archive's members, and members read from where the index says.

Python's own readers hold the whole directory of an archive. Here the directory is walked as a stream, and any part of it can
be read alone, so the members of one archive can be dealt to many tasks. Formats: the public zip format with its 64-bit
fields, stored, deflated, bzip2 and LZMA members; tar as Python's reader takes it from any header on.
"""

from __future__ import annotations

import bz2
import lzma
import os
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from bytelore.sources import store

#: Bytes read at once.
PIECE = 1 << 20
_END, _END64, _PLACE64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_ENCRYPTED, _UTF8 = 1, 0x800


@dataclass(frozen=True)
class Directory:
    """Where the entries of a zip file are, and what its own offsets are to be raised by."""

    start: int
    count: int
    shift: int


@dataclass(frozen=True)
class Entry:
    name: str
    flags: int
    method: int
    crc: int
    packed: int
    size: int
    header: int  # place of the local header in the file


def directory(f: BinaryIO) -> Directory:
    whole = f.seek(0, os.SEEK_END)
    back = min(whole, 22 + 65535)
    f.seek(whole - back)
    tail = f.read(back)
    at = tail.rfind(_END)
    if at < 0 or len(tail) - at < 22:
        raise zipfile.BadZipFile("no directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    end = whole - back + at
    if 0xFFFF == count or 0xFFFFFFFF in (size, start):
        f.seek(max(0, end - 20))
        pointer = f.read(20)
        if pointer[:4] == _PLACE64:
            (place,) = struct.unpack_from("<Q", pointer, 8)
            f.seek(place)
            record = f.read(56)
            if record[:4] != _END64:
                raise zipfile.BadZipFile("no 64-bit directory")
            count, size, start = struct.unpack_from("<QQQ", record, 32)
            end = place
    shift = end - size - start
    if shift < 0:
        raise zipfile.BadZipFile("directory out of place")
    return Directory(start + shift, count, shift)


def entries(f: BinaryIO, found: Directory, at: int | None = None, n: int | None = None) -> Iterator[tuple[int, Entry]]:
    """(place of the entry in the file, entry) of `n` entries from the place `at` on, or of all; read in pieces."""
    at, n = found.start if at is None else at, found.count if n is None else n
    held, base = b"", at
    f.seek(at)

    def have(size: int) -> None:
        nonlocal held, base
        missing = at + size - base - len(held)
        if missing > 0:
            held, base = held[at - base :], at
            f.seek(base + len(held))
            held += f.read(max(PIECE, missing))
            if len(held) < size:
                raise zipfile.BadZipFile("directory cut off")

    for _ in range(n):
        have(46)
        if held[at - base : at - base + 4] != _ENTRY:
            raise zipfile.BadZipFile("no entry where one should be")
        _, flags, method, _, crc, packed, size, name_size, extra_size, comment = struct.unpack_from("<4xIHHIIIIHHH", held, at - base)
        (header,) = struct.unpack_from("<I", held, at - base + 42)
        have(46 + name_size + extra_size + comment)
        raw = held[at - base + 46 : at - base + 46 + name_size]
        extra = held[at - base + 46 + name_size : at - base + 46 + name_size + extra_size]
        size, packed, header = _wide(extra, size, packed, header)
        yield at, Entry(raw.decode("utf-8" if flags & _UTF8 else "cp437"), flags, method, crc, packed, size, header + found.shift)
        at += 46 + name_size + extra_size + comment


def _wide(extra: bytes, *values: int) -> list[int]:
    """Values that don't fit in 32 bits stand in an extra field, in their order."""
    at, out = 0, list(values)
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            place = at + 4
            for k, v in enumerate(out):
                if v == 0xFFFFFFFF:
                    if place + 8 > at + 4 + size:
                        raise zipfile.BadZipFile("64-bit field cut off")
                    (out[k],) = struct.unpack_from("<Q", extra, place)
                    place += 8
            break
        at += 4 + size
    return out


def pieces(f: BinaryIO, entry: Entry) -> Iterator[bytes]:
    """The content of a member, in pieces; its checksum is tested at the end."""
    if entry.flags & _ENCRYPTED:
        raise RuntimeError(f"{entry.name} is encrypted")
    f.seek(entry.header)
    head = f.read(30)
    if head[:4] != _LOCAL or len(head) < 30:
        raise zipfile.BadZipFile(f"no member where {entry.name} should be")
    name_size, extra_size = struct.unpack_from("<HH", head, 26)
    at, left, crc, given = entry.header + 30 + name_size + extra_size, entry.packed, 0, 0
    unpacked = _unpacker(f, entry, at)
    f.seek(at)
    while left > 0 and given < entry.size:
        raw = f.read(min(left, 1 << 16))
        if not raw:
            raise EOFError(f"{entry.name} is cut off")
        left -= len(raw)
        for piece in unpacked(raw):
            crc = zlib.crc32(piece, crc)
            given += len(piece)
            yield piece
    if crc != entry.crc:
        raise zipfile.BadZipFile(f"wrong checksum of {entry.name}")


def _unpacker(f: BinaryIO, entry: Entry, at: int):
    if entry.method == zipfile.ZIP_STORED:
        return lambda raw: [raw]
    if entry.method == zipfile.ZIP_DEFLATED:
        state = zlib.decompressobj(-15)

        def inflated(raw: bytes) -> Iterator[bytes]:
            piece = state.decompress(raw, PIECE)
            while piece:
                yield piece
                piece = state.decompress(state.unconsumed_tail, PIECE)

        return inflated
    if entry.method == zipfile.ZIP_BZIP2:
        state = bz2.BZ2Decompressor()
    elif entry.method == zipfile.ZIP_LZMA:
        f.seek(at)
        (size,) = struct.unpack_from("<H", f.read(4), 2)
        filters = [lzma._decode_filter_properties(lzma.FILTER_LZMA1, f.read(size))]
        state, skip = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters), [4 + size]
    else:
        raise NotImplementedError(f"{entry.name}: method {entry.method}")
    dropped = skip if entry.method == zipfile.ZIP_LZMA else [0]

    def unpacked(raw: bytes) -> Iterator[bytes]:
        raw, dropped[0] = raw[dropped[0] :], max(0, dropped[0] - len(raw))
        piece = state.decompress(raw, PIECE)
        while piece:
            yield piece
            piece = b"" if state.eof or state.needs_input else state.decompress(b"", PIECE)

    return unpacked


def tar_headers(f: BinaryIO) -> Iterator[tuple[int, bool, int]]:
    """(place of the header, whether the member is regular, its size) of all members, in order; members are skipped, not read."""
    f.seek(0)
    with tarfile.open(fileobj=f, mode="r:") as t:
        while (item := t.next()) is not None:
            t.members = []  # what has been seen is not held
            yield item.offset, item.isfile(), item.size


def tar_entries(f: BinaryIO, at: int, n: int) -> Iterator[tuple[tarfile.TarInfo, tarfile.TarFile]]:
    """`n` members from the header at a place on."""
    f.seek(at)
    with tarfile.open(fileobj=f, mode="r:") as t:
        for _ in range(n):
            item = t.next()
            if item is None:
                return
            t.members = []
            yield item, t


def _entry_bytes(e: Entry, header: int) -> bytes:
    """An entry of a directory, with 64-bit fields where they are needed."""
    name = e.name.encode("utf-8" if e.flags & _UTF8 else "cp437")
    values = (e.size, e.packed, header)
    wide = [v for v in values if v >= 0xFFFFFFFF]
    extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
    size, packed, place = (min(v, 0xFFFFFFFF) for v in values)
    version = 45 if wide else 20
    return struct.pack("<4sHHHHHHIIIHHHHHII", _ENTRY, version, version, e.flags, e.method, 0, 0x21, e.crc, packed, size, len(name), len(extra), 0, 0, 0, 0o600 << 16, place) + name + extra


def joined(parts: list[str], target: str) -> None:
    """One zip file of the members of several, in their order; bytes are copied as they are, in pieces."""
    with store.created(target) as out:
        at, bases = 0, []
        for uri in parts:
            with store.opened(uri) as f:
                left = directory(f).start
                bases.append(at)
                at += left
                f.seek(0)
                while left:
                    piece = f.read(min(PIECE, left))
                    left -= len(piece)
                    out.write(piece)
        start, n = at, 0
        for uri, base in zip(parts, bases, strict=True):
            with store.opened(uri) as f:
                for _, e in entries(f, directory(f)):
                    raw = _entry_bytes(e, base + e.header)
                    out.write(raw)
                    at, n = at + len(raw), n + 1
        size = at - start
        if n >= 0xFFFF or size >= 0xFFFFFFFF or start >= 0xFFFFFFFF:
            out.write(struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<4sIQI", _PLACE64, 0, at, 1))
        out.write(struct.pack("<4sHHHHIIH", _END, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), min(start, 0xFFFFFFFF), 0))
