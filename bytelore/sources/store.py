"""Files by path or URI: of this machine, or of any store that Arrow's file systems know (HDFS, S3, ...). Only what is read is fetched."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator
from typing import BinaryIO

from pyarrow import fs

_SCHEME = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]+:/")


def local(name: str) -> str | None:
    """The path of a file of this machine; None for a URI of another store."""
    if not _SCHEME.match(name):
        return name
    return re.sub(r"^file:/+", "/", name) if name.startswith("file:/") else None


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a path or URI."""
    path = local(uri)
    return (fs.LocalFileSystem(), path) if path is not None else fs.FileSystem.from_uri(uri)


def opened(uri: str) -> BinaryIO:
    """A file to read and seek in."""
    path = local(uri)
    if path is not None:
        return open(path, "rb")
    files, path = located(uri)
    return io.BufferedReader(files.open_input_file(path), 1 << 16)


def created(uri: str) -> BinaryIO:
    """A new file to write, in a folder that is made if it is not there."""
    files, path = located(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    return files.open_output_stream(path)


def moved(source: str, target: str) -> None:
    files, path = located(source)
    files.move(path, located(target)[1])


def deleted(uri: str) -> None:
    """The file, or the folder with all that is in it, is gone; it need not have been there."""
    files, path = located(uri)
    kind = files.get_file_info(path).type
    if kind == fs.FileType.Directory:
        files.delete_dir(path)
    elif kind != fs.FileType.NotFound:
        files.delete_file(path)


def windows_of(uri: str, size: int) -> tuple[int, bytes, bytes]:
    """(bytes in all, first and last `size` bytes); nothing between them is read."""
    with opened(uri) as f:
        n = f.seek(0, os.SEEK_END)
        f.seek(0)
        first = f.read(size)
        if n <= size:
            return n, first, first
        f.seek(n - size)
        return n, first, f.read(size)


def level(uri: str) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder): a file itself, or what is in a folder; nothing if it is not there. Links to folders are not followed."""
    path = local(uri)
    if path is not None:
        path = os.path.normpath(path)
        if os.path.isfile(path):
            yield path, False
        elif os.path.isdir(path):
            with os.scandir(path) as entries:
                for e in entries:
                    if not e.is_dir():
                        yield e.path, False
                    elif not e.is_symlink():
                        yield e.path, True
        return
    files, path = located(uri)
    scheme = uri[: len(uri) - len(uri.split("://", 1)[-1])]
    authority = uri.split("://", 1)[-1].split("/", 1)[0] if not path.startswith(uri.split("://", 1)[-1].split("/", 1)[0]) else ""
    whole = lambda p: f"{scheme}{authority}{p}"
    found = files.get_file_info(path)
    if found.type == fs.FileType.File:
        yield uri, False
    elif found.type == fs.FileType.Directory:
        for e in files.get_file_info(fs.FileSelector(path)):
            yield whole(e.path), e.type == fs.FileType.Directory
