"""Benchmark decontamination by greedy string tiling (operator 6).

Method. A document is tiled against an item: running Karp-Rabin hashes of a search length find common runs of words that no
tile covers yet, the longest are marked first, and the search length falls to TILE words (to all words of a shorter item).
The share of the item's words under tiles is its coverage, in any order of its parts; a document covers an item from
COVERAGE on.

Which documents are tiled against which items is found by a join of shared seeds, runs of TILE words, that loses no pair.
Of an item's n words at most n - c are not under tiles if c are needed, so one of any n - c + 1 words is, and each word under
a tile lies in a seed of the document. For each item, the n - c + 1 neighbouring words are taken whose seeds are rarest,
counted over all documents and items: what many items or documents share, such as a line of instructions, is joined only
where an item has little else. Of the pairs that meet, those are tiled whose shared seeds cover c words of the item.

Items and documents are two tables that meet in joins which Spark can split; nothing but a bit field of fixed size (BITS) of
the items' seeds, which spares most documents the join, goes through the driver. Equal texts are looked at once.

Cases: null texts and texts without words cover nothing and are covered by nothing; an item of fewer than TILE words is
looked for as a whole; items and documents may share ids or have none: each row is judged by its text; a very long text
gives only those seeds that items have, and is tiled by its words that the item has; an empty table or an empty benchmark
gives no pairs; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelore.llm.common import arrow_batch, bounded, forget, mapped, stored, table, text_hash, unused
from bytelore.llm.near_copies import _hashes, kmer_hashes

TILE = 3
COVERAGE = 0.8
#: Bits of the field of seeds; it lets all seeds of items pass, and of others the share of bits that are set.
BITS = 1 << 23
_WORDS = re.compile(r"\w+")


def tokens(text: str) -> np.ndarray:
    parts = _WORDS.findall(text.lower())
    return np.fromiter(map(_hashes().__getitem__, parts), np.uint64, len(parts))


_BASE = 1_000_003
_MASK = (1 << 61) - 1


def _running(run: list[int], n: int) -> Iterator[int]:
    """Karp-Rabin hashes of all spans of n values."""
    h, high = 0, pow(_BASE, n, _MASK)
    for i, x in enumerate(run):
        h = (h * _BASE + x) % _MASK
        if i >= n:
            h = (h - run[i - n] * high) % _MASK
        if i >= n - 1:
            yield h


def tiles(item: list[int], text: list[int], least: int = TILE) -> list[tuple[int, int, int]]:
    """(start in the item, start in the text, length) of the tiles, the longest first; of equal ones the first in the item, then in the text.

    Whether a span is free is told by counts of words that are taken before each place. Of matches only the longest at their
    place are held; one that a longer tile has cut is replaced by what is left of it.
    """
    free_item, free_text = bytearray(b"\1" * len(item)), bytearray(b"\1" * len(text))
    found: list[tuple[int, int, int]] = []
    n, left = min(len(item), len(text)), len(item)
    while n >= least and left >= least:
        in_item, in_text = [0, *accumulate(free_item)], [0, *accumulate(free_text)]
        spans: dict[int, list[int]] = {}
        for start, h in enumerate(_running(item, n)):
            if in_item[start + n] - in_item[start] == n:
                spans.setdefault(h, []).append(start)
        matches = []
        for start, h in enumerate(_running(text, n)) if spans else ():
            if h not in spans or in_text[start + n] - in_text[start] < n:
                continue
            for at in spans[h]:
                if at and start and item[at - 1] == text[start - 1] and free_item[at - 1] and free_text[start - 1]:
                    continue  # part of the match that begins before it
                if item[at : at + n] == text[start : start + n]:
                    size = n
                    while at + size < len(item) and start + size < len(text) and free_item[at + size] and free_text[start + size] and item[at + size] == text[start + size]:
                        size += 1
                    matches.append((-size, at, start))
        heapify(matches)
        while matches and left >= least:
            size, at, start = heappop(matches)
            runs = _free_runs(free_item, free_text, at, start, -size)
            if runs == [(0, -size)]:
                free_item[at : at - size] = free_text[start : start - size] = bytes(-size)
                found.append((at, start, -size))
                left += size
            else:
                for offset, length in runs:
                    if length >= n:
                        heappush(matches, (-length, at + offset, start + offset))
        n = n // 2 if n >= 2 * least else least if n > least else 0
    return found


def _free_runs(free_item: bytearray, free_text: bytearray, at: int, start: int, size: int) -> list[tuple[int, int]]:
    """(offset, length) of the runs of a match in which both sides are free."""
    both = bytes(x & y for x, y in zip(free_item[at : at + size], free_text[start : start + size], strict=True))
    return [(m.start(), m.end() - m.start()) for m in _ONES.finditer(both)]


_ONES = re.compile(b"\1+")


def _shared(item: np.ndarray, text: np.ndarray) -> list[int]:
    """The text with each run of words that are not in the item as one mark, which matches nothing."""
    known = np.isin(text, item)
    keep = known.copy()
    keep[1:] |= known[:-1]
    return [x if y else -1 for x, y in zip(text[keep].tolist(), known[keep].tolist(), strict=True)]


def needed(n: int) -> int:
    """Words of an item of n words that must be under tiles."""
    return -(-int(round(COVERAGE * 1000)) * n // 1000)


def coverage(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """(share of the item's words under tiles, number of tiles)."""
    parts = tiles(item.tolist(), _shared(item, text), min(TILE, len(item)))
    return sum(p[2] for p in parts) / len(item), len(parts)


def item_table(items: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(item, item_id, words, seeds): a number for each item with words, and the seed at each of its positions."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for item, item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = tokens(text)
                if len(t):
                    for column, x in zip(out, (item, item_id, t.view(np.int64), kmer_hashes(t, TILE).view(np.int64)), strict=True):
                        column.append(x)
            yield arrow_batch(dict(zip(("item", "item_id", "words", "seeds"), zip(out, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True), strict=True)))

    rows = items.where(F.col(text_col).isNotNull()).select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return stored(mapped(rows, run, "item long, item_id long, words array<long>, seeds array<long>"))


def _bit_field(own: DataFrame) -> tuple[bytes, list[int]]:
    """Bits of all seeds, and the lengths of seeds in words (one, but for items of fewer than TILE)."""
    bit = F.col("seed").bitwiseAND(F.lit(BITS - 1))
    bits = own.select(F.explode("seeds").alias("seed")).groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST((seed & {BITS - 1}) % 64 AS INT))")).alias("bits"))
    field = np.zeros(BITS // 64, np.int64)
    for r in bits.collect():  # BITS / 64 rows at most
        field[r["at"]] = r["bits"]
    sizes = own.select(F.least(F.size("words"), F.lit(TILE)).alias("k")).distinct().collect()
    return field.tobytes(), sorted(r.k for r in sizes)


def document_seeds(docs: DataFrame, field: bytes, sizes: list[int]) -> DataFrame:
    """(h, seeds): for each different text of docs (h, text) its seeds in the bit field; none for texts without one."""

    def run(batches):
        bits = np.unpackbits(np.frombuffer(field, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            out: dict[bytes, np.ndarray] = {}
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if h not in out:
                    t = tokens(text)
                    found = [x[bits[x & np.uint64(BITS - 1)]] for k in sizes if len(t) >= k for x in (kmer_hashes(t, k),)]
                    out[h] = np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)
            kept = [(h, x) for h, x in out.items() if len(x)]
            yield arrow_batch({"h": ([h for h, _ in kept], pa.binary()), "seeds": ([x for _, x in kept], pa.list_(pa.int64()))})

    return stored(mapped(docs, run, "h binary, seeds array<long>").dropDuplicates(["h"]))


def rare_seeds(own: DataFrame, hits: DataFrame) -> DataFrame:
    """(seed, item): seeds of which a document that covers the item has one, chosen to join few rows."""
    placed = own.select("item", F.size("words").alias("n"), F.posexplode("seeds").alias("at", "seed"))
    in_items = placed.groupBy("seed").agg(F.count("*").alias("n_items"))
    in_docs = hits.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count("*").alias("n_docs"))
    costs = in_items.join(in_docs, "seed", "left").select("seed", (F.col("n_items").cast("double") * F.coalesce("n_docs", F.lit(0))).alias("cost"))
    lists = placed.join(costs, "seed").groupBy("item").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "seed", "cost"))).alias("all"))  # as long as the item's text

    def run(batches):
        for batch in batches:
            out: list[tuple[int, int]] = []
            for item, n, all_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seeds = [x["seed"] for x in all_]
                sums = np.concatenate([[0.0], np.cumsum([x["cost"] for x in all_])])
                k, width = n - len(seeds) + 1, n - needed(n) + 1
                first = np.arange(n - width + 1)
                low, high = np.maximum(0, first - k + 1), np.minimum(len(seeds), first + width)
                best = int(np.argmin(sums[high] - sums[low]))
                out += [(s, item) for s in set(seeds[low[best] : high[best]])]
            yield arrow_batch({"seed": ([s for s, _ in out], pa.int64()), "item": ([i for _, i in out], pa.int64())})

    return stored(mapped(lists.select("item", "n", F.col("all")), run, "seed long, item long"))


def _coverable(pairs: DataFrame) -> DataFrame:
    """(h, item) of the pairs (h, item, seeds, n, own) whose shared seeds cover as many words of the item as needed."""

    def run(batches):
        for batch in batches:
            h, items = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for seeds, n, own in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                own = own.values.to_numpy()
                here = np.flatnonzero(np.isin(own, seeds.values.to_numpy()))
                edges = np.zeros(n + 1, np.int64)
                np.add.at(edges, here, 1)
                np.add.at(edges, here + n - len(own) + 1, -1)
                keep.append(int((np.cumsum(edges[:n]) > 0).sum()) >= needed(n))
            yield arrow_batch({"h": ([x for x, k in zip(h, keep, strict=True) if k], pa.binary()), "item": ([x for x, k in zip(items, keep, strict=True) if k], pa.int64())})

    return mapped(pairs, run, "h binary, item long")


def _tiled(pairs: DataFrame) -> DataFrame:
    """(h, item_id, coverage, n_tiles) of the pairs (h, text, item_id, words) that reach COVERAGE."""

    def run(batches):
        for batch in batches:
            out, last, t = [], None, None
            for h, text, item_id, words in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if h != last:
                    last, t = h, tokens(text.as_py())
                share, n = coverage(words.values.to_numpy().view(np.uint64), t)
                if share >= COVERAGE:
                    out.append((h, item_id, share, n))
            c = list(zip(*out, strict=True)) or [()] * 4
            yield arrow_batch({"h": (list(c[0]), pa.binary()), "item_id": (list(c[1]), pa.int64()), "coverage": (list(c[2]), pa.float64()), "n_tiles": (list(c[3]), pa.int32())})

    return mapped(pairs, run, "h binary, item_id long, coverage double, n_tiles int")


def covered_texts(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(h, item_id, coverage, n_tiles): a row for each different text, by its hash, and each item that it covers."""
    own = item_table(items, item_col)
    docs = df.where(F.col(text_col).isNotNull()).select(text_hash(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    hits = document_seeds(docs, *_bit_field(own))
    seeds = rare_seeds(own, hits)
    met = hits.select("h", F.explode("seeds").alias("seed")).join(bounded(seeds, seeds.count()), "seed").select("h", "item").distinct()
    pairs = met.join(hits, "h").join(own.select("item", F.size("words").alias("n"), F.col("seeds").alias("own")), "item")
    pairs = stored(_coverable(pairs.select("h", "item", "seeds", "n", "own")))
    wanted = stored(pairs.select("h").distinct())
    texts = docs.join(bounded(wanted, wanted.count()), "h", "left_semi").dropDuplicates(["h"])
    whole = pairs.join(own.select("item", "item_id", "words"), "item").join(texts, "h")
    found = stored(_tiled(whole.select("h", "text", "item_id", "words")))
    for old in (own, hits, seeds, pairs, wanted):
        forget(old)
    return found


def covering(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item_id, coverage, n_tiles): a row for each document and item that it covers."""
    found = covered_texts(df, items, text_col, item_col)
    rows = df.select(F.col(id_col).cast("long").alias(id_col), text_hash(text_col).alias("h"))
    return rows.join(found, "h").select(id_col, *[c for c in ("item_id", "coverage", "n_tiles")])


def without_covering(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows, with all their columns, of documents that cover no item."""
    found = stored(covered_texts(df, items, text_col, item_col).select("h").distinct())
    own_h = unused(df, "own_h")
    out = df.withColumn(own_h, text_hash(text_col)).join(bounded(found.select(F.col("h").alias(own_h)), found.count()), own_h, "left_anti")
    return out.select(*df.columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
