"""Members of zip, tar and compound files, and deep scans of registered ones."""

from __future__ import annotations

import io
import re
import shutil
import struct
import tarfile
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from time import perf_counter
from typing import BinaryIO

from bytelore.sources import store, zips
from bytelore.sources.compound import CompoundFile

BROKEN = (zipfile.BadZipFile, RuntimeError, UnicodeDecodeError, NotImplementedError, EOFError, OSError, ValueError, LookupError, struct.error, zlib.error, tarfile.TarError)


def _listed(source: BinaryIO, kind: str, wanted: list[str]) -> dict[str, bytes]:
    """Registered path -> content of those that are there; nothing else of the file is read."""
    if kind == "ZIP":
        found = {e.name: e for _, e in zips.entries(source, zips.directory(source)) if e.name in wanted}
        return {p: b"".join(zips.pieces(source, found[p])) for p in wanted if p in found}
    whole, found = CompoundFile(source), {}
    for path, entry in whole.streams():
        for p in wanted:
            if p not in found and (path == p or path[1:] == p):
                found[p] = entry
    return {p: whole.read(found[p]) for p in wanted if p in found}


def container_hits(data: bytes | BinaryIO, kind: str, signatures: list[tuple], notes: list[str] | None = None) -> list[str]:
    """Puids of the container signatures that hold, by path, then puid, then signature; damaged containers have none, which is noted."""
    plan: dict[str, dict[str, list[str]]] = {}
    for what, path, puid, regex in signatures:
        if what == kind:
            plan.setdefault(path, {}).setdefault(puid, []).append(regex)
    try:
        found = _listed(io.BytesIO(data) if isinstance(data, bytes) else data, kind, list(plan))
    except BROKEN as e:
        if notes is not None:
            notes.append(f"container: {e}")
        return []
    out = []
    for path, by_puid in plan.items():
        if path in found:
            for puid, expressions in by_puid.items():
                for regex in expressions:
                    try:
                        if re.search(regex.encode(), found[path]):
                            out.append(puid)
                    except re.error:
                        continue
    return out


#: Bytes of a member read at once; nested archives above SPOOL go to disk.
PIECE, SPOOL = 1 << 20, 1 << 23


def _entries(source: BinaryIO, kind: str) -> Iterator[tuple[str, int, Callable[[], BinaryIO]]]:
    """(name, size, opener) of regular members."""
    if kind == "zip":
        with zipfile.ZipFile(source) as z:
            for item in z.infolist():
                if item.file_size:
                    yield item.filename, item.file_size, partial(z.open, item)
    else:
        with tarfile.open(fileobj=source, mode="r:") as t:
            for item in t:
                if item.isfile():
                    yield item.name, item.size, partial(t.extractfile, item)


def _windows(source: BinaryIO, n: int) -> tuple[bytes, bytes]:
    """The first and the last n bytes of a stream, which is read to its end in pieces."""
    return _ends(iter(lambda: source.read(PIECE), b""), n)


def _judged(full: str, kind: str, first: bytes, last: bytes, registry, options, notes: list[str]) -> tuple[list, str]:
    """Matches of a member and their label."""
    hits = registry.resolve(registry.candidates(first, last, notes))
    if kind == "zip" and not hits and options.extension:
        return [(i, [(0, "External")]) for i in registry.by_extension(full)], "extension"
    return hits, "signature" if kind == "zip" else ""


def members(name: str, data: bytes | BinaryIO, kind: str, registry, options, notes: list[str] | None = None) -> list[tuple]:
    """(filename, size, time_ms, matches, label, place) of members, depth first; what can't be read ends the walk of its archive, and is noted.

    Of a member only its two windows are kept; archives in it are copied to a spooled file while they are walked.
    """
    out: list[tuple] = []
    notes = [] if notes is None else notes
    walks = [(_entries(io.BytesIO(data) if isinstance(data, bytes) else data, kind), name, kind, "", None)]
    counts = [0]
    while walks:
        entries, outer, kind, path, spool = walks[-1]
        try:
            inner, size, opened = next(entries)
        except (StopIteration, *BROKEN) as e:
            if not isinstance(e, StopIteration):
                notes.append(f"{outer}: {e}")
            entries.close()
            if spool:
                spool.close()
            walks.pop()
            counts.pop()
            continue
        counts[-1] += 1
        place = f"{path}{counts[-1]:08d}/"
        full = f"{outer}!{inner}"
        began = perf_counter()
        try:
            with opened() as source:
                first, last = _windows(source, options.bufsize)
        except BROKEN as e:
            notes.append(f"{full}: {e}")
            if kind == "zip":
                out.append((full, size, 0, [], "", place))
                continue
            entries.close()  # a tar can't be read on from here
            continue
        hits, label = _judged(full, kind, first, last, registry, options, notes)
        if hits or options.extension or kind == "tar":
            out.append((full, size, int((perf_counter() - began) * 1000), registry.described(hits), label, place))
        inside = registry.container_type([i for i, _ in hits])
        if inside in ("zip", "tar"):
            copy = tempfile.SpooledTemporaryFile(SPOOL)
            try:
                with opened() as source:
                    shutil.copyfileobj(source, copy, PIECE)
                copy.seek(0)
            except BROKEN as e:
                notes.append(f"{full}: {e}")
                copy.close()
                continue
            walks.append((_entries(copy, inside), full, inside, place, copy))
            counts.append(0)
    return out


#: Members of a range, and bytes of its packed members, at which a range ends.
MEMBERS_EACH, BYTES_EACH = 1000, 1 << 28


def ranges(source: BinaryIO, kind: str) -> list[tuple[int, int, int]]:
    """(regular members before, place of the first entry or header, entries) of parts of an archive, found without reading its members."""
    out, before, load = [], 0, 0
    if kind == "zip":
        walk = ((at, e.size > 0, e.packed) for at, e in zips.entries(source, zips.directory(source)))
    else:
        walk = zips.tar_headers(source)
    for at, counts, size in walk:
        if not out or out[-1][2] >= MEMBERS_EACH or load > BYTES_EACH:
            out.append([before, at, 0])
            load = 0
        out[-1][2] += 1
        load += size
        before += counts
    return [tuple(r) for r in out]


def range_members(name: str, source: BinaryIO, kind: str, place: str, part: tuple[int, int, int], registry, options, keep: Callable[[Iterator[bytes]], str]) -> Iterator[tuple]:
    """(filename, size, time_ms, matches, label, place, note, uri, kind, ranges) of the members of a range of an archive.

    An archive among them is kept by `keep`, which gives its URI, and has its own ranges. What can't be read is noted at the
    member; in a tar it ends the range.
    """
    before, at, n = part
    for entry, size, opened in _range_entries(source, kind, at, n):
        before += 1
        full, own_place, began, notes = f"{name}!{entry}", f"{place}{before:08d}/", perf_counter(), []
        try:
            first, last = _ends(opened(), options.bufsize)
        except BROKEN as e:
            yield full, size, 0, [], "" if kind == "zip" else "fail", own_place, str(e), None, None, []
            if kind == "zip":
                continue
            return
        hits, label = _judged(full, kind, first, last, registry, options, notes)
        took = int((perf_counter() - began) * 1000)
        inside, uri, parts = registry.container_type([i for i, _ in hits]), None, []
        if inside in ("zip", "tar"):
            try:
                uri = keep(opened())
                with store.opened(uri) as copy:
                    parts = ranges(copy, inside)
            except BROKEN as e:
                notes.append(f"{full}: {e}")
        if hits or options.extension or kind == "tar":
            yield full, size, took, registry.described(hits), label, own_place, "; ".join(notes) or None, uri if parts else None, inside if parts else None, parts


def _range_entries(source: BinaryIO, kind: str, at: int, n: int) -> Iterator[tuple[str, int, Callable[[], Iterator[bytes]]]]:
    """(name, size, opener) of the regular members of a range."""
    if kind == "zip":
        for _, e in list(zips.entries(source, zips.directory(source), at, n)):
            if e.size:
                yield e.name, e.size, partial(zips.pieces, source, e)
    else:
        for item, t in zips.tar_entries(source, at, n):
            if item.isfile():
                yield item.name, item.size, partial(_read_pieces, t, item)


def _read_pieces(t: tarfile.TarFile, item: tarfile.TarInfo) -> Iterator[bytes]:
    with t.extractfile(item) as f:
        while piece := f.read(PIECE):
            yield piece


def _ends(parts: Iterator[bytes], n: int) -> tuple[bytes, bytes]:
    """The first and the last n bytes of what comes in pieces."""
    first = last = b""
    for piece in parts:
        if len(first) < n:
            first += piece[: n - len(first)]
        last = (last + piece)[-n:] if n else b""
    return first, last
