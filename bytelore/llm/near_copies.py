"""Near copies by order min-hash and banded alignment (operator 7).

Method. Equal texts are one (128-bit hash), and each different text has a number of its own, so rows that share an id are
still told apart. Of each text, every run of KMER lower-cased words, labelled with the number of its earlier occurrences, is
a k-mer (a shorter text is one). Each of SKETCHES seeded orders picks the PICK smallest k-mers and keeps them in text order;
the picks of one order are a key of one band. Edits that are scattered over a text leave few runs of five words, so there are
two more such families: runs of FINE words (texts over FEW words), and single words (texts of up to MANY words); of two texts
that can link, both have one of these, as the longer one has at most 1 / SIMILARITY times the other's words. Texts of up to
SHORT words also have the key of every text that is left when as many words are deleted as a link allows: two of them that
link share one. Texts that meet in a key are candidates. A pair is linked if its words align, with insertions and deletions only, over at least
SIMILARITY of the longer text: a bit-parallel longest common subsequence inside the band that this similarity allows.
Classes are the connected components of the links; the class id is the least id in it.

In each key, texts are compared with the one of least number: each text first with the least of those of all its keys, then
with the others that are not in its component by then, so a group of near copies takes about a pair for each text, not one
for each of its keys. Those that are still not in the component go on to the next round, in which the least of them takes
its place. After the first round that links fewer than one in LEAST_YIELD of its
pairs, all that is left is finished exactly (`rest`): every two members of a key that are in different components by then
and were not compared. Keys of up to CROWD texts compare such pairs directly; the texts of larger ones (keys of a passage
that many texts share) meet by a prefix filter that loses no link. Words of a text, each labelled with the number of its
earlier occurrences, are put in one order, rare ones first. Of n words, at most n - need can be missing in a text it links
with, so two texts that link share one of their first n - need + 1 words. Texts of different components that meet in such a
word are compared if their lengths allow a link and they have enough words in common, in whatever order: all are counted in
texts of up to WHOLE words; of longer ones the first ones and REACH more, and all behind these are taken for common.
The keys' least numbers come from pre-aggregated sums, the joins are plain ones that can be split where a key is hot.

So no pair that meets in a key is left out, but for those that another path already put in one class. What can be missed is
a pair of longer texts with so many scattered edits that no sketch agrees; the README has the recall by share of edits.

Cases: a null text is a class of its own for each id; equal texts are copies, also empty ones; other texts without words have
no k-mers; a row without id has no class; repeated rows share id and class; different texts under one id are judged apart
(`representatives` keeps the right one of them); a very long text is sketched in bounded pieces and aligned in its band; an
empty table gives no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelore.llm import common
from bytelore.llm.common import arrow_batch, bounded, forget, held, mapped, stored, table, text_hash, unused

KMER = 5
SIMILARITY = 0.8
SKETCHES, PICK = 10, 2
#: Words of a finer run, its orders and picks; orders and picks of single words; words above and up to which a text has them.
FINE, FINE_SKETCHES, FINE_PICK = 3, 30, 2
WORD_SKETCHES, WORD_PICK = 24, 4
FEW, MANY = 64, 80
LEAST_YIELD = 20
#: Words of a text up to which its deletions are keys.
SHORT = 14
#: Members of a key up to which all pairs are compared; buckets of the counts that order words; texts of a cell; entries of a part; the share of words beyond the first ones that are compared before alignment; words up to which a text has all of them compared; sums of these words.
CROWD, BUCKETS, CELL, PART, REACH, WHOLE, SUMS = 32, 1 << 18, 2000, 50_000, 0.25, 2048, 256
#: Buckets whose sums are one row.
STRIP = 4096
#: Bytes of texts' words that are dealt out to parts at once.
AT_ONCE = 1 << 31
#: Bits of the field of hashes that texts are passed by before they are moved.
FIELD = 1 << 23
KEPT_WORDS = 200_000
#: Tables of up to SMALL_ROWS short rows are written by one task for each TASK_ROWS; larger ones as they are partitioned.
SMALL_ROWS, TASK_ROWS = 20_000_000, 200_000

_SEEDS = np.random.default_rng(20).integers(1, 2**63, SKETCHES + FINE_SKETCHES + WORD_SKETCHES, dtype=np.uint64)
_FULL = (1 << 64) - 1
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _hashes() -> _WordHashes:
    return held("word hashes", _WordHashes)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[str]:
    return text.lower().split()


def word_hashes(text: str) -> np.ndarray:
    parts = words(text)
    return np.fromiter(map(_hashes().__getitem__, parts), np.uint64, len(parts))


def kmer_hashes(w: np.ndarray, k: int = KMER) -> np.ndarray:
    """Hash of every run of k words; of all of them if there are fewer."""
    if not len(w):
        return w
    k = min(k, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
    return _mixed(h)


def labelled(h: np.ndarray) -> np.ndarray:
    """The n-th occurrence of a hash differs from the others."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.empty(len(h), bool)
    new[:1] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    if new.all():
        return h
    at = np.arange(len(h))
    nth = np.empty(len(h), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(nth > 0, _mixed(h + nth * _B), h)


def deletions(w: np.ndarray) -> list[int]:
    """Keys of the words of a short text with up to as many of them left out as a link with an equally long text allows."""
    n = len(w)
    out = {0: (w * _A).tolist()}
    kept = [out[0]]
    for gone in range(1, n - needed(n) + 1):
        kept += [[x for i, x in enumerate(out[0]) if i not in left] for left in combinations(range(n), gone)]
    keys = set()
    for part in kept:
        h = len(part) + 1
        for x in part:
            h = ((h ^ x) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _FULL
        keys.add(h - (1 << 64) if h >> 63 else h)
    return sorted(keys)


def picked(h: np.ndarray, seeds: np.ndarray, pick: int) -> np.ndarray:
    """A key for each seeded order: the least hashes, in text order."""
    pick = min(pick, len(h))
    keys = []
    step = max(1, (1 << 18) // len(h))
    for at in range(0, len(seeds), step):  # bounded memory for long texts
        v = _mixed(h[None, :] ^ seeds[at : at + step, None])
        least = np.argpartition(v, pick - 1, axis=1)[:, :pick] if pick < len(h) else np.tile(np.arange(len(h)), (len(v), 1))
        least.sort(axis=1)
        key = seeds[at : at + step] + np.uint64(pick)
        for j in range(pick):
            key = _mixed(key * _A + h[least[:, j]])
        keys.append(key)
    return np.concatenate(keys)


def sketch(text: str) -> list[int]:
    """Keys of a text in all families; none for a text without words."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return []
    families = [picked(labelled(kmer_hashes(w)), _SEEDS[:SKETCHES], PICK)]
    if n > FEW:
        families.append(picked(labelled(kmer_hashes(w, FINE)), _SEEDS[SKETCHES : SKETCHES + FINE_SKETCHES], FINE_PICK))
    if n <= MANY:
        families.append(picked(labelled(w), _SEEDS[SKETCHES + FINE_SKETCHES :], WORD_PICK))
    found = np.concatenate(families).view(np.int64).tolist()
    return found + deletions(w) if n <= SHORT else found


def needed(longer: int, similarity: float = SIMILARITY) -> int:
    """Words that a common subsequence has at least."""
    return -(-int(round(similarity * 1000)) * longer // 1000)


def alignable(a: list[str], b: list[str], similarity: float = SIMILARITY) -> bool:
    """Whether a common subsequence covers `similarity` of the longer list: a bit-parallel search in the band that allows it."""
    longer = max(len(a), len(b))
    need = needed(longer, similarity)
    if min(len(a), len(b)) < need:
        return False
    if a == b:
        return True
    if sum((Counter(a) & Counter(b)).values()) < need:
        return False
    start, end_a, end_b = 0, len(a), len(b)
    while start < min(end_a, end_b) and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    need -= start + len(a) - end_a
    if need <= 0:
        return True
    a, b = a[start:end_a], b[start:end_b]
    left, right = len(b) - need, len(a) - need  # skipped words of b and of a at most
    if left < 0 or right < 0:
        return False
    places: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    width = left + right + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    often = {w: _bits(p, len(a)) for w, p in sorted(places.items(), key=lambda x: -len(x[1]))[:256] if len(p) > 64}
    row, found = mask, 0
    for j, w in enumerate(b):
        base = j - left  # column of the lowest bit
        if w in often:
            hits = (often[w] >> base if base >= 0 else often[w] << -base) & mask
        else:
            hits, p = 0, places.get(w, ())
            for i in p[bisect_left(p, base) :] if len(p) > 4 else p:
                if base <= i < base + width:
                    hits |= 1 << (i - base)
                elif i >= base + width:
                    break
        if hits:
            both = row & hits
            row = ((row + both) | (row - both)) & mask
        found += not row & 1
        row = row >> 1 | top
    return found + width - row.bit_count() >= need


def _bits(places: list[int], n: int) -> int:
    raw = bytearray(n // 8 + 1)
    for i in places:
        raw[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(raw, "little")


def sketched(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, sketch) of each row."""

    def run(batches):
        for batch in batches:
            h, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            known: dict[bytes, list[int]] = {b"": []}
            for x, t in zip(h, texts, strict=True):
                if x not in known:
                    known[x] = sketch(t)
            yield arrow_batch({"id": (batch.column(0), pa.int64()), "h": (batch.column(1), pa.binary()), "sketch": ([known[x] for x in h], pa.list_(pa.int64()))})

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, run, "id long, h binary, sketch array<long>")


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def verdicts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(tid, pivot, ok) of the pairs (tid, pivot): whether their texts align."""

    def run(batches):
        last, last_words = None, []
        for batch in batches:
            tids, pivots, a, b = (c.to_pylist() for c in batch.columns)
            ok = []
            for pivot, x, y in zip(pivots, a, b, strict=True):
                if pivot != last:
                    last, last_words = pivot, words(y)
                ok.append(alignable(words(x), last_words))
            yield arrow_batch({"tid": (tids, pa.int64()), "pivot": (pivots, pa.int64()), "ok": (ok, pa.bool_())})

    pairs = stored(pairs)
    n = pairs.count()
    only = bounded(pairs.select("pivot").distinct(), n)  # texts are moved only where they are needed
    of_pivot = texts.select(F.col("tid").alias("pivot"), F.col("text").alias("pivot_text")).join(only, "pivot", "left_semi")
    whole = texts.join(bounded(pairs, n), "tid").join(of_pivot, "pivot").select("tid", "pivot", "text", "pivot_text")
    return mapped(whole, run, "tid long, pivot long, ok boolean")


def _first(w: np.ndarray, counts: np.ndarray, more: int = 0) -> np.ndarray:
    """The labelled words of a text, rare ones first, of which two texts that link share one, and some more."""
    h = labelled(w)
    return h[np.lexsort((h, counts[(h % np.uint64(BUCKETS)).astype(np.int64)]))[: len(w) - needed(len(w)) + 1 + more]]


def _counts(texts: DataFrame, order: np.ndarray | None = None) -> np.ndarray:
    """Counts of labelled words, or of the first ones in an order, in BUCKETS sums: as an order any are exact, as counts they are never too low."""

    def run(batches):
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                w = word_hashes(text)
                at, n = np.unique((labelled(w) if order is None else _first(w, order)) % np.uint64(BUCKETS), return_counts=True)
                sums[at.astype(np.int64)] += n
        yield packed(enumerate(sums.reshape(-1, STRIP)))

    def packed(strips):
        full = [(k, x.tobytes()) for k, x in strips if x.any()]
        return arrow_batch({"strip": ([k for k, _ in full], pa.int32()), "sums": ([x for _, x in full], pa.binary())})

    def merged(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(x, np.int64)
                found[k] = found[k] + x if k in found else x
        yield packed(found.items())

    out = np.zeros(BUCKETS, np.int64).reshape(-1, STRIP)
    strips = mapped(texts.select("text"), run, "strip int, sums binary")  # a few rows of each task, summed by strip
    for r in mapped(strips.repartition("strip"), merged, "strip int, sums binary").collect():  # one row for each strip
        out[r.strip] = np.frombuffer(r.sums, np.int64)
    return out.reshape(-1)


_DEALT = "tid long, root long, n long, rare binary, first binary, parts array<long>, cells array<binary>"


def _first_words(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """Rows of _DEALT: each text with the parts in which it can meet another one, and its cells in each of them.

    A cell is a first word that other texts have, too; a word that more than CELL texts have is dealt out in blocks of
    texts, of which every two meet in a cell. Cells are dealt out to parts, so many that each has about PART entries. rare
    has two bytes of each of the text's words, of more than WHOLE those up to REACH behind the first ones, first has the first
    words, cells the place of a word among these, its two blocks and the text's own.
    """
    times = _counts(texts, counts)
    parts = int(times[times > 1].sum()) // PART + 1

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for tid, root, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = word_hashes(text)
                rare = _first(w, counts, max(WHOLE, int(REACH * len(w))))
                first = rare[: len(w) - needed(len(w)) + 1]
                n = times[(first % np.uint64(BUCKETS)).astype(np.int64)]
                at = np.flatnonzero(n > 1)
                if not len(at):
                    continue
                blocks = -(-n[at] // CELL)
                own = (int(_mixed(np.array([tid], np.uint64))[0]) % blocks.astype(object)).astype(np.int64)
                own, beside, at = np.repeat(own, blocks), np.concatenate([np.arange(k) for k in blocks]), np.repeat(at, blocks)
                cells = np.stack([at, np.minimum(own, beside), np.maximum(own, beside), own], axis=1)
                part = (_mixed(first[at] + _A * (cells[:, 1] * 1000003 + cells[:, 2]).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                own_cells = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
                row = tid, root, len(w), np.sort(rare.astype(np.uint16)).tobytes(), first.tobytes(), [int(part[c[0]]) for c in own_cells], [cells[c].tobytes() for c in own_cells]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            names = [x.split()[0] for x in _DEALT.split(", ")]
            kinds = [*[pa.int64()] * 3, *[pa.binary()] * 2, pa.list_(pa.int64()), pa.list_(pa.binary())]
            yield arrow_batch(dict(zip(names, zip(out, kinds, strict=True), strict=True)))

    return mapped(texts.select("tid", "root", "text"), run, _DEALT)


def _part_pairs(rows: list[tuple]) -> list[tuple[int, int]]:
    """(larger number, smaller number) of the texts of a part that meet in a cell, each pair in that of the first word they share, if they
    are in different components and their lengths and words allow a link."""
    tids, roots, n = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
    rare, first = [np.frombuffer(r[4], np.uint16) for r in rows], [np.frombuffer(r[5], np.int64) for r in rows]
    behind = n - np.array([len(x) for x in rare])
    sums = np.zeros((len(rows), SUMS), np.uint16 if n.max() < 1 << 16 else np.int64)
    for k, x in enumerate(rare):
        sums[k] = np.bincount(x % SUMS, minlength=SUMS)
    cells = [np.frombuffer(r[6], np.int64).reshape(-1, 4) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(c) for c in cells])
    place, low, high, block = np.concatenate(cells).T
    word = np.concatenate([f[c[:, 0]] for f, c in zip(first, cells, strict=True)])
    order = np.lexsort((high, low, word))
    owner, place, low, high, block, word = (x[order] for x in (owner, place, low, high, block, word))
    ends = np.flatnonzero((np.diff(word) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
    out = []
    for start, end in zip([0, *ends.tolist()], [*ends.tolist(), len(word)], strict=True):
        here = owner[start:end]
        if end - start < 2 or (roots[here] == roots[here[0]]).all():
            continue
        earlier: dict[int, frozenset] = {}
        before = lambda k: earlier[k] if k in earlier else earlier.setdefault(k, frozenset(first[owner[k]][: place[k]].tolist()))  # noqa: E731, B023
        across = low[start] != high[start]
        for i in range(start, end - 1):
            x, others = owner[i], owner[i + 1 : end]
            need = -(-int(round(SIMILARITY * 1000)) * np.maximum(n[others], n[x]) // 1000)
            ok = (np.minimum(n[others], n[x]) >= need) & (roots[others] != roots[x])
            if across:
                ok &= block[i + 1 : end] != block[i]
            at = np.flatnonzero(ok)
            at = at[np.minimum(sums[others[at]], sums[x]).sum(1, dtype=np.int64) + np.maximum(behind[others[at]], behind[x]) >= need[at]]  # no pair has more in common
            for k in at.tolist():
                y = others[k]
                if before(i).isdisjoint(before(i + 1 + k)) and _in_both(rare[x], rare[y]) + max(behind[x], behind[y]) >= need[k]:
                    out.append((max(tids[x], tids[y]), min(tids[x], tids[y])))
    return out


def _in_both(a: np.ndarray, b: np.ndarray) -> int:
    """How many entries of a are in b, both sorted; at least as many as they truly share."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _parts(batches):
    """Pairs (tid, pivot), each once, of rows that are sorted by part; a part can go over several batches."""
    held: list[tuple] = []
    pair = lambda found: arrow_batch({"tid": ([x for x, _ in found], pa.int64()), "pivot": ([y for _, y in found], pa.int64())})
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield pair(_part_pairs(held))
                held = []
            held.append(row)
    if held:
        yield pair(_part_pairs(held))


def crowded_pairs(texts: DataFrame) -> DataFrame:
    """(tid, pivot) of all texts (tid, root, text) of different roots that can link, each pair once.

    A text goes to as many parts as it has cells, if there are many parts. So parts are dealt out in turns, each of about
    AT_ONCE bytes, and the shuffle files of one turn are gone when the next begins.
    """
    texts = stored(texts)
    shared = texts.repartition("tid")  # each text takes long, and they lie in few files
    whole = stored(_first_words(shared, _counts(texts)))
    forget(texts)
    size = F.size("parts").cast("long") * (F.octet_length("rare") + F.octet_length("first")) + F.aggregate("cells", F.lit(0), lambda n, x: n + F.octet_length(x))
    turns = -(-(whole.agg(F.sum(size)).first()[0] or 0) // AT_ONCE)
    found = [stored(mapped(_dealt(whole, k, turns), _parts, "tid long, pivot long")) for k in range(max(1, turns))]
    forget(whole)
    return _all(found)


def _dealt(whole: DataFrame, turn: int, turns: int) -> DataFrame:
    """(part, tid, root, n, rare, first, cells) of the parts of a turn, a row for each text and part, by part."""
    own = F.filter(F.arrays_zip("parts", "cells"), lambda x: F.pmod(x["parts"], F.lit(max(1, turns))) == turn)
    rows = whole.select("tid", "root", "n", "rare", "first", F.explode(own).alias("own")).select("own.parts", *whole.columns[:5], "own.cells")
    return rows.withColumnRenamed("parts", "part").repartition("part").sortWithinPartitions("part")


def _rooted(df: DataFrame, roots: DataFrame | None, column: str, to: str) -> DataFrame:
    """`to`: the root of the text in `column`, itself if it has none."""
    if roots is None:
        return df.withColumn(to, F.col(column))
    return df.join(roots.select(F.col("tid").alias(column), F.col("root").alias(to)), column, "left").withColumn(to, F.coalesce(to, column))


def rest(keyed: DataFrame, roots: DataFrame | None, texts: DataFrame) -> DataFrame:
    """(tid, pivot) of all pairs in keys (key, tid) that are in different components and can link."""
    whole = stored(_rooted(keyed, roots, "tid", "root"))
    sizes = stored(whole.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "m"))
    few = whole.join(sizes.where(F.col("m") <= CROWD), "key").select("key", "tid", "root")
    pairs = few.join(few.select("key", F.col("tid").alias("pivot"), F.col("root").alias("other")), "key").where("tid > pivot AND root <> other").select("tid", "pivot")
    crowd = stored(whole.join(sizes.where(F.col("m") > CROWD), "key", "left_semi").select("tid", "root").distinct())
    n = crowd.count()
    if n:
        pairs = pairs.unionByName(crowded_pairs(texts.join(bounded(crowd, n), "tid")))
    found = stored(pairs.distinct())
    for old in (whole, sizes, crowd):
        forget(old)
    return found


def compact(df: DataFrame, rows: int) -> DataFrame:
    """As few tasks as `rows` need, for small tables; larger ones keep their partitions."""
    return df.coalesce(-(-rows // TASK_ROWS)) if 0 < rows <= SMALL_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """(tid, root) of every text in the edges (tid, pivot) that isn't the least of its component: large and small stars in turn."""
    n = 2 * edges.count()
    small = lambda df: stored(compact(df, n))
    edges = small(edges.where("tid <> pivot").select(F.greatest("tid", "pivot").alias("tid"), F.least("tid", "pivot").alias("root")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("tid"), F.col("tid").alias("root")))
        least = small(both.groupBy("tid").agg(F.min("root").alias("least")).withColumn("least", F.least("tid", "least")))
        large = both.join(least, "tid").where("root > tid").select(F.col("root").alias("tid"), F.col("least").alias("root"))
        large = small(large.unionByName(least.where("least < tid").select("tid", F.col("least").alias("root"))).distinct())
        least_below = small(large.groupBy("tid").agg(F.min("root").alias("least")))
        below = large.join(least_below, "tid").where("root <> least").select(F.col("root").alias("tid"), F.col("least").alias("root"))
        new = small(below.unionByName(least_below.select("tid", F.col("least").alias("root"))).distinct())
        for old in (edges, least, large, least_below):
            forget(old)
        edges, before = new, state
        row = new.agg(F.count("*"), F.sum(F.xxhash64("tid", "root").cast("decimal(38,0)"))).first()
        state = (row[0], row[1])
        if state == before:
            return new


def found_links(keyed: DataFrame, kinds: DataFrame, source: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """(tid, root) of the texts that aren't the least of their component, and what can be forgotten once that is read. Keys of a single text are left behind at once."""
    n, texts, judged, roots, active, shared = kinds.count() * (SKETCHES + FINE_SKETCHES), None, [], None, keyed, None
    while True:
        pivots = stored(compact(active.groupBy("key").agg(F.min("tid").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot"), n))
        members = stored(compact(active.join(pivots, "key"), n))
        for old in (pivots, active):
            forget(old)
        if shared is None:
            shared = members
        met = members.where("tid <> pivot")
        n = met.count()
        if not n:
            return roots, [x for x in (texts, *judged, roots, members, shared) if x is not None]
        pairs = met.select("tid", "pivot").distinct()
        if texts is None:  # later rounds only have texts that met in the first
            tids = stored(compact(met.select(F.explode(F.array("tid", "pivot")).alias("tid")).distinct().join(kinds.select("tid", "id", "h"), "tid"), n))
            same, n_tids = [F.col("source_id") == F.col("id"), F.col("source_h") == F.col("h")], tids.count()
            some = source if n_tids <= common.BROADCAST_ROWS else passed(source, "source_h", tids)
            texts = stored(some.join(bounded(tids, n_tids), same).select("tid", "text").dropDuplicates(["tid"]))
            forget(tids)
        else:
            pairs = pairs.join(_all(judged).select("tid", "pivot"), ["tid", "pivot"], "left_anti")
        pairs, compared, linked = stored(pairs), 0, 0
        for step in (_least, _apart):
            judged.append(stored(verdicts(step(pairs, roots, judged[-1] if judged else None), texts)))
            some, ok = judged[-1].agg(F.count("*"), F.count_if("ok")).first()
            roots, compared, linked = _new_roots(judged, roots, ok), compared + some, linked + ok
        forget(pairs)
        if linked * LEAST_YIELD < compared:
            break
        met_roots = _rooted(_rooted(met, roots, "tid", "root"), roots, "pivot", "pivot_root")
        active = stored(compact(met_roots.where("root <> pivot_root").select("key", "tid"), n))
        if members is not shared:
            forget(members)
    if members is not shared:
        forget(members)
    pairs = rest(shared.select("key", "tid"), roots, texts)
    judged.append(stored(verdicts(pairs.join(_all(judged).select("tid", "pivot"), ["tid", "pivot"], "left_anti"), texts)))
    forget(pairs)
    forget(shared)
    roots = _new_roots(judged, roots, judged[-1].where("ok").limit(1).count())
    return roots, [x for x in (texts, *judged, roots) if x is not None]


def passed(source: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of the source whose hash in `column` can be one of the wanted ones (h), by a bit field of fixed size: all wanted rows, and few others,
    so that a join that shuffles need not move them."""
    place = lambda h: F.xxhash64(h).bitwiseAND(F.lit(FIELD - 1))
    bits = wanted.select(place("h").alias("at")).groupBy(F.shiftright("at", 6).alias("strip")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))
    field = np.zeros(FIELD // 64, np.int64)
    strips = bits.toArrow()  # FIELD / 64 rows at most
    field[strips.column("strip").to_numpy()] = strips.column("bits").to_numpy()
    at = place(F.col(column))
    one = F.conv(F.hex(F.substring(F.lit(field.tobytes()), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return source.where(F.getbit(one, (at % 8).cast("int")) == 1)


def _least(pairs: DataFrame, roots: DataFrame | None, judged: DataFrame | None) -> DataFrame:
    """One pair of each text, with the least of the texts it met: enough for nearly all of a group of near copies."""
    return pairs.groupBy("tid").agg(F.min("pivot").alias("pivot"))


def _apart(pairs: DataFrame, roots: DataFrame | None, judged: DataFrame) -> DataFrame:
    """The other pairs, but for those whose texts are in one component by now."""
    rooted = _rooted(_rooted(pairs, roots, "tid", "root"), roots, "pivot", "pivot_root")
    return rooted.where("root <> pivot_root").select("tid", "pivot").join(judged.select("tid", "pivot"), ["tid", "pivot"], "left_anti")


def _new_roots(judged: list[DataFrame], roots: DataFrame | None, linked: int) -> DataFrame | None:
    """Roots after the last links: components of the links between the roots that were."""
    if not linked:
        return roots
    links = judged[-1].where("ok").select("tid", "pivot")
    if roots is None:
        return components(links)
    between = _rooted(_rooted(links, roots, "tid", "a"), roots, "pivot", "b").where("a <> b").select(F.col("a").alias("tid"), F.col("b").alias("pivot")).distinct()
    merged = components(between)
    moved = roots.join(merged.select(F.col("tid").alias("root"), F.col("root").alias("to")), "root", "left").select("tid", F.coalesce("to", "root").alias("root"))
    new = stored(moved.unionByName(merged))
    forget(merged)
    forget(roots)
    return new


def classified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, class_id, representative): a row for each row; h tells texts apart."""
    base = stored(sketched(df, id_col, text_col))
    kinds = base.where("octet_length(h) > 0 AND id IS NOT NULL").groupBy("h").agg(F.min(F.struct("id", "sketch")).alias("m"))
    kinds = stored(kinds.select(F.monotonically_increasing_id().alias("tid"), "h", "m.id", "m.sketch"))
    source = df.select(F.col(id_col).cast("long").alias("source_id"), text_hash(text_col).alias("source_h"), F.col(text_col).cast("string").alias("text"))
    keyed = stored(kinds.select(F.explode("sketch").alias("key"), "tid"))
    roots, done = found_links(keyed, kinds, source)
    texts = kinds.select("tid", "h", "id")
    if roots is None:
        named = texts.select("h", F.col("id").alias("class_id"), F.col("h").alias("class_h"))
    else:
        members = roots.select("tid", "root").unionByName(roots.select(F.col("root").alias("tid"), "root").distinct())
        least = members.join(texts, "tid").groupBy("root").agg(F.min(F.struct("id", "h")).alias("least"))
        named = texts.join(members.join(least, "root"), "tid", "left").select("h", F.coalesce("least.id", "id").alias("class_id"), F.coalesce("least.h", "h").alias("class_h"))
    named = stored(named)
    for old in (*done, kinds):
        forget(old)
    joined = base.select("id", "h").join(named, "h", "left")
    class_id = F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id"))
    first = (F.col("id") == F.coalesce("class_id", "id")) & (F.col("h") == F.coalesce("class_h", "h"))
    return joined.select("id", "h", class_id.alias("class_id"), F.coalesce(first, F.lit(False)).alias("representative"))


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, representative): a row for each row; `representative` marks the rows of the text that stands for its class."""
    return classified(df, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "representative")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: of the least id and, where that has several texts, of the least hash; rows without id stay."""
    classes = stored(classified(df, id_col, text_col))
    own_id, own_h, times = (unused(df, x) for x in ("own_id", "own_h", "times"))
    kept = classes.where("representative").groupBy(F.col("id").alias(own_id), F.col("h").alias(own_h)).agg(F.count("*").alias(times))
    rows = df.withColumns({own_id: F.col(id_col).cast("long"), own_h: text_hash(text_col)})
    out = rows.join(kept, [own_id, own_h], "left").where(F.col(times).isNotNull() | F.col(own_id).isNull())
    if not kept.where(F.col(times) > 1).isEmpty():  # repeated rows: a single one stays
        once, more = out.where((F.col(times) == 1) | F.col(times).isNull()), out.where(F.col(times) > 1).dropDuplicates([own_id, own_h])
        out = once.unionByName(more)
    return out.select(*df.columns)


def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
