"""Document fingerprints by prefix polynomial hashes (operator 3).

Method. For two moduli, the prefix array of a text holds sum(code point * base^i) of each prefix. Differences of its
entries, brought to the same power, compare any two spans in constant time, and binary search over them finds the longest
common extension at any two positions (`PrefixHashes`).

A fingerprint is a part of that array that fits in a row: the prefix values at up to MARKS positions, and at the end. The
positions are chosen by content, where the hash of the WINDOW characters before them ends in many zero bits, so the same
passage has the same marks wherever it stands; a short text has a mark at every character. Beside them, there are the values
of the first MARKS, 2 MARKS, 4 MARKS characters and so on, for texts that repeat one word and have few marks. Spans between any two marks of
two fingerprints can be compared as in the whole array. Likeness is a function of the two fingerprints: the share of the
longer text that common spans between marks cover, in the same order in both. It is found by the longest common extension
from both beginnings and both ends, by binary search over marks, and between them by the best common sequence of spans. It
is 1 for equal texts, also empty ones; an edit costs the spans it touches, each about a MARKS-th of the text.

The array of an edited text is made from those of its two sources, without reading their characters again. The next
document comes from a range partitioning by id, see `neighbours`.

Cases: null text is read as empty; the next document of the last is the first, of a single one itself; rows with equal ids
follow each other by a hash of their texts, equal rows in any order, which gives the same results; null ids come first; a
very long text has as many marks as any other, farther apart; of a text that repeats one word, which has few marks, only a
common beginning is seen; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelore.llm.common import spark_schema, table, text_column
from bytelore.llm.neighbours import with_neighbours

#: Fixed values: (modulus, base).
FIELDS = ((2147483647, 911382323), (2147483629, 972663749))
MARKS, WINDOW = 32, 8
MOST_ZEROS = 25
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: (modulus, base) of each field, and of the first one's inverse.
_BASES = [*FIELDS, (FIELDS[0][0], pow(FIELDS[0][1], -1, FIELDS[0][0]))]
_powers = [np.ones(1, np.int64) for _ in _BASES]


def powers(n: int) -> list[np.ndarray]:
    """base^0 to base^n at least, for each field and the inverse."""
    for k, (p, b) in enumerate(_BASES):
        while len(_powers[k]) <= n:
            have = _powers[k]
            _powers[k] = np.concatenate([have, have * pow(b, len(have), p) % p])
    return _powers


class Marks(NamedTuple):
    """What a fingerprint says: length, least zeros of its marks, their positions, zeros and prefix values (with start and end), prefix values at doubling lengths, value of the whole text in the second field."""

    size: int
    zeros_least: int
    at: list[int]
    zeros: list[int]
    values: list[int]
    begins: list[int]
    check: int

    def text(self) -> str:
        steps = "".join(f"{chr(65 + z)}{b - a:x}" for a, b, z in zip(self.at, self.at[1:-1], self.zeros[1:-1], strict=False))
        values = base64.urlsafe_b64encode(np.array(self.values[1:] + self.begins, ">u4").tobytes()).decode().rstrip("=")
        return f"{self.size:x}.{self.zeros_least:x}.{self.check:x}:{steps}:{values}"

    @classmethod
    def parsed(cls, fingerprint: str) -> Marks:
        head, steps, values = fingerprint.split(":")
        size, least, check = (int(x, 16) for x in head.split("."))
        at, zeros = [0], [MOST_ZEROS]
        for z, step in re.findall("([A-Z])([0-9a-f]+)", steps):
            at.append(at[-1] + int(step, 16))
            zeros.append(ord(z) - 65)
        raw = base64.urlsafe_b64decode(values + "=" * (-len(values) % 4))
        numbers = np.frombuffer(raw, ">u4").tolist()
        return cls(size, least, [*at, size], [*zeros, MOST_ZEROS], [0, *numbers[: len(at)]], numbers[len(at) :], check)

    def coarser(self, least: int) -> Marks:
        """The marks with `least` zeros at least; any two of them can still be compared."""
        if least <= self.zeros_least:
            return self
        keep = [i for i, z in enumerate(self.zeros) if z >= least or i in (0, len(self.zeros) - 1)]
        return self._replace(zeros_least=least, at=[self.at[i] for i in keep], zeros=[self.zeros[i] for i in keep], values=[self.values[i] for i in keep])

    def equal(self, i: int, other: Marks, j: int, n: int) -> bool:
        """Whether the text between marks i and i + n equals that between the other's marks j and j + n."""
        if self.at[i + n] - self.at[i] != other.at[j + n] - other.at[j]:
            return False
        w = powers(max(self.size, other.size))[0]
        return ((self.values[i + n] - self.values[i]) * int(w[other.at[j]]) - (other.values[j + n] - other.values[j]) * int(w[self.at[i]])) % FIELDS[0][0] == 0

    def extension(self, other: Marks) -> int:
        """Spans that both texts begin with."""
        low, high = 0, min(len(self.at), len(other.at)) - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(0, other, 0, middle) else (low, middle - 1)
        return low

    def ending(self, other: Marks, most: int) -> int:
        """Spans that both texts end with, `most` at most."""
        low, high = 0, most
        a, b = len(self.at) - 1, len(other.at) - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(a - middle, other, b - middle, middle) else (low, middle - 1)
        return low

    def spans(self, start: int, end: int) -> list[tuple[int, int]]:
        """(length, hash from power 0) of the spans between marks start to end."""
        if start >= end:
            return []
        at, values = np.array(self.at[start : end + 1]), np.array(self.values[start : end + 1])
        hashes = np.diff(values) % FIELDS[0][0] * powers(self.size)[2][at[:-1]] % FIELDS[0][0]
        return list(zip(np.diff(at).tolist(), hashes.tolist(), strict=True))


def likeness(a: Marks | str, b: Marks | str) -> float:
    """Likeness of two fingerprints, from 0 to 1."""
    a, b = (Marks.parsed(x) if isinstance(x, str) else x for x in (a, b))
    longer = max(a.size, b.size)
    if a.size == b.size and (a.values[-1], a.check) == (b.values[-1], b.check):
        return 1.0
    least = max(a.zeros_least, b.zeros_least)
    a, b = a.coarser(least), b.coarser(least)
    head = a.extension(b)
    tail = a.ending(b, min(len(a.at), len(b.at)) - 1 - head)
    end_a, end_b = len(a.at) - 1 - tail, len(b.at) - 1 - tail
    start = min(max([a.at[head], *(MARKS << k for k, (x, y) in enumerate(zip(a.begins, b.begins, strict=False)) if x == y)]), a.at[end_a], b.at[end_b])
    same = start + a.size - a.at[end_a]
    x, y = a.spans(bisect_left(a.at, start), end_a), b.spans(bisect_left(b.at, start), end_b)
    both = set(x) & set(y)
    x, y = [s for s in x if s in both], [s for s in y if s in both]
    best = [0] * (len(y) + 1)
    for s in x:  # at most MARKS spans on either side
        before = 0
        for j, t in enumerate(y, 1):
            before, best[j] = best[j], max(before + s[0] if s == t else 0, best[j], best[j - 1])
    return min(1.0, (same + best[-1]) / longer)


class PrefixHashes:
    """Prefix arrays of one text."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays
        self.size = len(arrays[0]) - 1

    @classmethod
    def of(cls, text: str) -> PrefixHashes:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        return cls([np.concatenate([[0], np.cumsum(codes * w[: len(codes)] % p) % p]) for w, (p, _) in zip(powers(len(codes)), FIELDS, strict=False)])

    def joined(self, keep: int, other: PrefixHashes, take: int) -> PrefixHashes:
        """Arrays of the first `keep` characters followed by the first `take` of another text."""
        w = powers(keep)
        return PrefixHashes([np.concatenate([a[: keep + 1], (a[keep] + w[k][keep] * b[1 : take + 1]) % FIELDS[k][0]]) for k, (a, b) in enumerate(zip(self.arrays, other.arrays, strict=True))])

    def equal(self, i: int, other: PrefixHashes, j: int, n: int) -> bool:
        """Whether n characters from i equal those of the other text from j."""
        w = powers(max(i, j))
        for k, (p, _) in enumerate(FIELDS):
            a, b = self.arrays[k], other.arrays[k]
            if (int(a[i + n] - a[i]) % p * int(w[k][j]) - int(b[j + n] - b[j]) % p * int(w[k][i])) % p:
                return False
        return True

    def extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest common extension forward from i and j."""
        low, high = 0, min(self.size - i, other.size - j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(i, other, j, middle) else (low, middle - 1)
        return low

    def _mixed(self) -> np.ndarray:
        """For each position from WINDOW to the last but one, a hash of the characters before it."""
        n = max(0, self.size - WINDOW)
        (p, _), a = FIELDS[0], self.arrays[0]
        h = (a[WINDOW : WINDOW + n] - a[:n]) % p * powers(n)[2][:n] % p  # all brought to power 0
        x = (h.astype(np.uint64) + np.uint64(1)) * _MIX
        return x ^ x >> np.uint64(32)

    def marks(self) -> Marks:
        n, x = self.size, self._mixed()
        if n <= MARKS:
            least, here = 0, np.arange(len(x))
            first = np.arange(1, min(n, WINDOW))
        else:
            ends_in = lambda x, k: np.flatnonzero(x & np.uint64((1 << k) - 1) == 0)
            least, first = max(1, (n // MARKS).bit_length() - 1), np.zeros(0, np.int64)
            here = ends_in(x, least)
            while len(here) <= MARKS and least > 1 and len(finer := ends_in(x, least - 1)) <= MARKS:
                least, here = least - 1, finer
            while len(here) > MARKS:
                least += 1
                here = here[ends_in(x[here], least)]
        low = x[here]
        zeros = np.minimum(np.log2((low & (~low + np.uint64(1))).astype(np.float64) + (low == 0)), MOST_ZEROS).astype(np.int64)
        at, zeros = [*first.tolist(), *(here + WINDOW).tolist()], [0] * len(first) + zeros.tolist()
        a, b = self.arrays
        begins = [int(a[MARKS << k]) for k in range(n.bit_length()) if MARKS << k < n]
        return Marks(n, least, [0, *at, n], [MOST_ZEROS, *zeros, MOST_ZEROS], [0, *a[at].tolist(), int(a[n])], begins, int(b[n]))

    def fingerprint(self) -> str:
        return self.marks().text()


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))


def fingerprinted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    schema = spark_schema((id_col, "long"), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"))
    kept: dict[str, tuple[PrefixHashes, Marks]] = {}

    def of(text: str) -> tuple[PrefixHashes, Marks]:
        if text not in kept:
            for old in list(kept)[:-1]:
                del kept[old]
            made = PrefixHashes.of(text)
            kept[text] = made, made.marks()
        return kept[text]

    def make(_, row, after):
        text, then = row[1], after[1]
        (own, marks), (other, next_marks) = of(text), of(then)
        half = len(text) // 2
        keep = len(text) - half
        edited = own.joined(keep, other, min(half, len(then))).marks()
        digest = hashlib.sha256((text[:keep] + then[:half]).encode("utf-8", "surrogatepass")).hexdigest()
        return row[0], len(text), digest, marks.text(), edited.text(), likeness(marks, edited), likeness(marks, next_marks)

    rows = df.select(F.col(id_col).cast("long").alias(id_col), text_column(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    return with_neighbours(rows, [id_col, "h"], schema, make, around=True)  # range bounds hold the order's values, so no texts
