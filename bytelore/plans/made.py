"""Files that queries and tests make to have something to read."""

from __future__ import annotations

import struct
from typing import BinaryIO

FREE, END, TABLE, MORE = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC


def write_compound(f: BinaryIO, streams: list[tuple[str, bytes | int]], shift: int = 9) -> None:
    """A compound file of streams (path, content); a number is the length of a stream of zeros, for which nothing is written. Short streams go to the mini stream."""
    size = 1 << shift
    chains: list[int] = []  # of the whole file
    f.seek(size)
    sectors = lambda n: -(-n // size)

    def put(data: bytes | int) -> int:
        """The first sector of new content."""
        n = sectors(data if isinstance(data, int) else len(data))
        if not n:
            return END
        start = len(chains)
        chains.extend([*range(start + 1, start + n), END])
        f.seek((start + 1) * size)
        if not isinstance(data, int):
            f.write(data.ljust(n * size, b"\0"))
        return start

    mini, mini_chains, placed = bytearray(), [], {}
    for path, data in streams:
        n = data if isinstance(data, int) else len(data)
        if n >= 4096:
            placed[path] = put(data), n
            continue
        units, start = -(-n // 64), len(mini_chains)
        mini_chains += [*range(start + 1, start + units), END] if units else []
        mini += (data if isinstance(data, bytes) else bytes(n)).ljust(units * 64, b"\0")
        placed[path] = start if units else END, n
    mini_start = put(bytes(mini))
    mini_table = put(struct.pack(f"<{len(mini_chains)}I", *mini_chains).ljust(sectors(4 * len(mini_chains)) * size, b"\xff"))

    entries: list[list] = [["Root Entry", 5, FREE, FREE, FREE, mini_start, len(mini)]]
    folders = {"": 0}
    last: dict[int, int] = {}  # children of a folder are a tree that only leans to the right

    def add(name: str, kind: int, folder: int, start: int, n: int) -> int:
        entries.append([name, kind, FREE, FREE, FREE, start, n])
        k = len(entries) - 1
        if folder in last:
            entries[last[folder]][3] = k
        else:
            entries[folder][4] = k
        last[folder] = k
        return k

    for path, (start, n) in placed.items():
        *above, name = path.split("/")
        for depth in range(len(above)):
            folder = "/".join(above[: depth + 1])
            if folder not in folders:
                folders[folder] = add(above[depth], 1, folders["/".join(above[:depth])], 0, 0)
        add(name, 2, folders["/".join(above)], start, n)
    raw = b""
    for name, kind, left, right, child, start, n in entries:
        text = name.encode("utf-16-le") + b"\0\0"
        raw += text.ljust(64, b"\0") + struct.pack("<HBB", len(text), kind, 1) + struct.pack("<III", left, right, child) + bytes(36) + struct.pack("<IQ", start, n)
    directory = put(raw.ljust(sectors(len(raw)) * size, b"\0"))

    each = size // 4
    tables = more = 0
    while (need := -(-(len(chains) + tables + more) // each)) > tables or (again := -(-max(0, tables - 109) // (each - 1))) > more:
        tables, more = max(tables, need), -(-max(0, max(tables, need) - 109) // (each - 1))
    at, more_at = len(chains), len(chains) + tables
    chains += [TABLE] * tables + [MORE] * more
    f.seek((at + 1) * size)
    f.write(struct.pack(f"<{len(chains)}I", *chains).ljust(tables * size, b"\xff"))
    numbers = [at + k for k in range(tables)]
    for k in range(more):
        some = numbers[109 + k * (each - 1) : 109 + (k + 1) * (each - 1)]
        f.seek((more_at + k + 1) * size)
        f.write(struct.pack(f"<{each}I", *some, *[FREE] * (each - 1 - len(some)), more_at + k + 1 if k + 1 < more else END))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3 if shift == 9 else 4, 0xFFFE, shift, 6) + bytes(6)
    head += struct.pack("<IIIIIIIII", 0, tables, directory, 0, 4096, mini_table, sectors(4 * len(mini_chains)), more_at if more else END, more)
    f.seek(0)
    f.write((head + struct.pack("<109I", *numbers[:109], *[FREE] * (109 - len(numbers[:109])))).ljust(size, b"\0"))
