"""Registries of formats: union and override of files, filters, and the compiled form that tasks use."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelore import schema
from bytelore.functions.names import extension
from bytelore.functions.reach import needle, reach

ZIP, TAR, OLE = "zip", "tar", "ole"
#: Fixed value: the format whose objects are compound files.
OLE_PUID = "fmt/111"
#: Formats that a broadcast takes at most; registries have a few thousand.
BROADCAST_FORMATS = 50_000


def combine(*files: DataFrame) -> DataFrame:
    """Formats of several files: a later file's format replaces an earlier one of the same puid, in the earlier place.

    A file has 2^32 places, and `ord` is its number and the place in it.
    """
    rows = None
    for k, f in enumerate(files):
        part = f.withColumn("source_ord", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    whole = F.struct(*[c for c in rows.columns if c != "ord"])
    place = F.struct("source_ord", "ord")
    merged = rows.groupBy("puid").agg(F.max_by(whole, place).alias("last"), F.min(place).alias("first"))
    return merged.select("first", "last.*").withColumn("ord", F.shiftleft(F.col("first.source_ord").cast("long"), 32) + F.col("first.ord")).select("ord", *[c for c in rows.columns if c != "ord"])


def include(formats: DataFrame, puids: list[str]) -> DataFrame:
    return formats.where(F.col("puid").isin(puids))


def exclude(formats: DataFrame, puids: list[str]) -> DataFrame:
    return formats.where(~F.col("puid").isin(puids))


def small(df: DataFrame, n: int | None = None) -> DataFrame:
    """A registry side for a join: broadcast if it is below a size, left to the planner else."""
    return F.broadcast(df) if (df.limit(BROADCAST_FORMATS + 1).count() if n is None else n) <= BROADCAST_FORMATS else df


def priority_edges(formats: DataFrame) -> DataFrame:
    """(puid, inferior): each pair once."""
    return formats.select("puid", F.explode(F.array_distinct("has_priority_over")).alias("inferior"))


def extension_table(formats: DataFrame) -> DataFrame:
    """(ext, ord, puid): each extension of a format once."""
    return formats.select(F.explode("extension").alias("ext"), "ord", "puid").dropDuplicates(["ext", "puid"])


_HEAD = re.compile(r"\(\?s\)\\A(?:\.\{(\d+)\})?")
_UNIT = re.compile(r"\\x([0-9a-fA-F]{2})|\\([nr])|\\([^a-zA-Z0-9])|([^\\$()*+.?!\[\]^{|}])", re.S)


def literal(regex: str) -> tuple[int, bytes] | None:
    """(offset, bytes) that an expression needs at a fixed place, if that can be read off its beginning."""
    head = _HEAD.match(regex)
    if not head:
        return None
    depth, i = 0, head.end()
    while i < len(regex):  # an alternative at the top would make the beginning optional
        c = regex[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = max(i, regex.find("]", i + 2))
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return None
        i += 1
    at, out = head.end(), []
    while m := _UNIT.match(regex, at):
        if m[4] and ord(m[4]) > 127:
            break
        out.append(int(m[1], 16) if m[1] else {"n": 10, "r": 13}[m[2]] if m[2] else ord(m[3] or m[4]))
        at = m.end()
    if out and regex[at : at + 1] in ("?", "*", "+", "{"):
        out.pop()
    return (int(head[1] or 0), bytes(out)) if out else None


def _automaton(words: dict[bytes, list[int]]):
    """All words in one automaton, which finds them in one pass; None if there are none."""
    if not words:
        return None
    made = ahocorasick.Automaton()
    for word, formats in words.items():
        made.add_word(word.decode("latin-1"), tuple(formats))
    made.make_automaton()
    return made


@dataclass
class Compiled:
    """Formats as tasks use them: expressions over bytes, compiled once in each worker."""

    formats: list[tuple]  # (ord, puid, container, priorities, [(name, [(position, regex)])], extensions), in order
    containers: list[tuple] = field(default_factory=list)  # (type, path, puid, regex), in order

    def __post_init__(self):
        self.by_puid = {f[1]: i for i, f in enumerate(self.formats)}
        self._ready = None

    def __getstate__(self):
        return self.formats, self.containers

    def __setstate__(self, state):
        self.formats, self.containers = state
        self.__post_init__()

    def _prepare(self):
        at_place: dict[tuple[int, int], dict[bytes, list[int]]] = {}
        anywhere: tuple[dict[bytes, list[int]], dict[bytes, list[int]]] = {}, {}  # in the first and in the last window
        always, tests = [], []
        for i, (_, _, _, _, signatures, _) in enumerate(self.formats):
            compiled, needed, bad = [], [], False
            for name, patterns in signatures:
                ready, own = [], []
                for position, regex in patterns:
                    try:
                        test = re.compile(regex.encode())
                        ready.append((position, reach(regex, position) or test))
                    except (re.error, OverflowError) as e:
                        ready.append((position, e))
                        bad = True
                    if found := needle(regex, position):
                        own.append((position, found))
                compiled.append((name, ready))
                needed.append(max(own, key=lambda x: x[1].worth(), default=None))
            tests.append(compiled)
            if bad or not all(needed):
                always.append(i)
                continue
            for position, found in needed:
                if found.place is None:
                    anywhere[position == "EOF"].setdefault(found.text, []).append(i)
                else:
                    at_place.setdefault((found.place, len(found.text)), {}).setdefault(found.text, []).append(i)
        self._ready = at_place, [_automaton(x) for x in anywhere], always, tests

    def candidates(self, bof: bytes, eof: bytes, notes: list[str] | None = None) -> list[tuple[int, list[tuple[int, str]]]]:
        """(index, [(signature, name)]) of all formats with a signature that holds, in order; errors drop a format's later signatures, and are noted.

        Only formats whose bytes are there are tried: bytes at a fixed place by a look-up, others by one pass of all of them over each window.
        """
        if self._ready is None:
            self._prepare()
        at_place, passes, always, tests = self._ready
        chosen = set(always)
        for (place, size), by_text in at_place.items():
            there = bof[place : place + size] if place >= 0 else eof[len(eof) + place : len(eof) + place + size] if len(eof) + place >= 0 else b""
            chosen.update(by_text.get(there, ()))
        for automaton, window in zip(passes, (bof, eof), strict=True):
            if automaton is not None:
                for _, formats in automaton.iter(window.decode("latin-1")):
                    chosen.update(formats)
        out = []
        for i in sorted(chosen):
            hits = []
            try:
                for k, (name, patterns) in enumerate(tests[i]):
                    if all(_holds(position, test, bof, eof) for position, test in patterns):
                        hits.append((k, name))
            except Exception as e:  # noqa: BLE001  a broken expression must not stop the scan of other formats
                if notes is not None:
                    notes.append(f"{self.formats[i][1]}: {e}")
            if hits:
                out.append((i, hits))
        return out

    def resolve(self, candidates: list[tuple[int, list[tuple[int, str]]]]) -> list[tuple[int, list[tuple[int, str]]]]:
        """Order-sensitive suppression: a format counts if no accepted one has priority over it; dominated ones go at the end."""
        accepted: list = []
        for c in candidates:
            if not any(self._over(a[0], c[0]) for a in accepted):
                accepted.append(c)
        return [c for c in accepted if not any(self._over(a[0], c[0]) for a in accepted)]

    def _over(self, i: int, j: int) -> bool:
        return i != j and self.formats[j][1] in self.formats[i][3]

    def described(self, hits: list[tuple[int, list[tuple[int, str | None]]]]) -> list[dict]:
        """Matches as rows hold them."""
        return [{"ord": self.formats[i][0], "puid": self.formats[i][1], "prio": sorted(self.formats[i][3]), "sigs": [{"sig_ord": k, "name": n} for k, n in sigs]} for i, sigs in hits]

    def by_extension(self, filename: str) -> list[int]:
        """Formats with the name's extension, without dominated ones."""
        ext = extension(filename)
        found = [i for i, f in enumerate(self.formats) if ext and ext in f[5]]
        return [j for j in found if not any(self._over(i, j) for i in found)]

    def container_type(self, matches: list[int]) -> str | None:
        for i in matches:
            if self.formats[i][2]:
                return self.formats[i][2]
            if self.formats[i][1] == OLE_PUID:
                return OLE
        return None


def _holds(position: str, test, bof: bytes, eof: bytes) -> bool:
    if isinstance(test, Exception):
        if position in ("BOF", "EOF", "VAR", "IFB"):
            raise test
        return True
    if position == "BOF":
        return test.match(bof) is not None
    if position == "EOF":
        return test.search(eof) is not None
    if position in ("VAR", "IFB"):
        return test.search(bof) is not None
    return True


def compiled(formats: DataFrame, containers: DataFrame | None = None) -> Compiled:
    """The registry for tasks; it is collected, as it has a few thousand rows."""
    rows = formats.orderBy("ord").collect()
    made = []
    for r in rows:
        signatures = [(s.name, [(p.position, p.regex or "") for p in (s.pattern or [])]) for s in (r.signature or [])]
        made.append((r.ord, r.puid, r.container, frozenset(r.has_priority_over or []), signatures, frozenset(r.extension or [])))
    found = [(c.container_type, c.path, c.puid, c.regex) for c in containers.orderBy("ord").collect()] if containers is not None else []
    return Compiled(made, found)


@lru_cache(maxsize=4)
def loaded(packed: bytes) -> Compiled:
    """One compiled registry for each worker and registry."""
    import pickle

    return pickle.loads(packed)
