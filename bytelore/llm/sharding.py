"""Reproducible shuffle into shards by a Feistel permutation of global row numbers (operator 5).

Method. Rows are numbered 0 to N-1 by id (ties by size, then checksum): a range partitioning by id, a sort inside each
partition, and the number of rows in the partitions before it, so no task holds more than its range. A balanced Feistel
network over pairs of digits to the base a = ceil(sqrt(N)) permutes 0 to a*a-1; values of N and more are permuted again
until they fall below N (cycle walking), which permutes 0 to N-1. Position p goes to shard p mod k, slot p div k, so
shards differ by one row at most, slots have no gaps, and shard and slot of any row follow from its number alone.

A walk leaves 0..N-1 for at most a*a - N < 2a steps. WALKS steps are made in one expression; rows that are not home then,
which hardly ever happens, walk on until all are. A seed other than 0 gives another permutation.

Cases: a null text has size 1 and checksum 0 (no bytes); null ids come first; repeated rows get numbers of their own; of a
very long text only size and checksum are moved; an empty table gives no rows; other columns are ignored. Only built-in functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bytelore.llm.common import forget, stored, table, text_column

SHARDS = 16
WALKS = 64
#: Multiplier, addend, second multiplier of each round; all below 2^31.
ROUND_KEYS = [(1103515245, 12345, 1664525), (69069, 362437, 22695477), (1566083941, 77777, 134775813), (1812433253, 5489, 214013), (630360016, 1013904223, 16807), (742938285, 2531011, 48271)]
MODULUS = 2147483647


def permuted_sql(value: str, n: int, seed: int = 0, walking: bool = False) -> str:
    """SQL of the permutation of 0..n-1, for Spark, after WALKS steps at most; `walking`: the value is on its way already."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    keys = ", ".join(f"named_struct('m', {m}L, 'c', {(c + seed * (k + 1)) % MODULUS}L, 'w', {w}L)" for k, (m, c, w) in enumerate(ROUND_KEYS))
    once = lambda x: (
        f"aggregate(array({keys}), named_struct('l', {x} div {a}L, 'r', {x} % {a}L), (s, k) -> named_struct('l', s.r, 'r', "
        f"(s.l + ((((s.r * k.m + k.c) % {MODULUS}L) * k.w + ((s.r * k.m + k.c) % {MODULUS}L) div 65536L) % {MODULUS}L) % {a}L) % {a}L), s -> s.l * {a}L + s.r)"
    )
    return f"aggregate(sequence(1, {WALKS}), {value if walking else once(value)}, (v, i) -> IF(v < {n}L, v, {once('v')}))"


def permuted(rows: DataFrame, n: int, seed: int = 0, value: str = "row_number") -> DataFrame:
    """`rows` with the place of each in the column _at."""
    placed = stored(rows.withColumn("_at", F.expr(permuted_sql(value, n, seed))))
    while not placed.where(F.col("_at") >= n).isEmpty():
        further = stored(placed.withColumn("_at", F.expr(permuted_sql("_at", n, seed, walking=True))))
        forget(placed)
        placed = further
    return placed


def numbered(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """`df` with global row numbers from 0 in column row_number, and the number of rows."""
    place = F.monotonically_increasing_id()
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place))
    rows = rows.withColumn("_part", F.shiftright("_place", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_rows"))  # as many rows as partitions
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_place") - F.shiftleft(F.col("_part"), 33)
    out = rows.join(F.broadcast(offsets), "_part").withColumn("row_number", F.col("_before") + inside)
    return out.drop("_place", "_part", "_before"), rows.count()


def sharded(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(id, size, text_crc32, shard, slot)."""
    small = df.select(
        F.col(id_col).cast("long").alias(id_col),
        (F.octet_length(text_column(text_col)).cast("long") + 1).alias("size"),
        F.crc32(text_column(text_col).cast("binary")).alias("text_crc32"),
    )
    rows, n = numbered(small, id_col, "size", "text_crc32")
    rows = permuted(rows, n, seed)
    return rows.select(id_col, "size", "text_crc32", (F.col("_at") % shards).cast("int").alias("shard"), F.expr(f"_at div {shards}").alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _oracle() -> str:
    keys = ", ".join(f"{{'m': {m}::BIGINT, 'c': {c}::BIGINT, 'w': {w}::BIGINT}}" for m, c, w in ROUND_KEYS)
    step = f"(SELECT list_reduce(list_prepend({{'l': x // a, 'r': x % a, 'm': 0::BIGINT, 'c': 0::BIGINT, 'w': 0::BIGINT}}, list_transform([{keys}], lambda k: {{'l': 0::BIGINT, 'r': 0::BIGINT, 'm': k.m, 'c': k.c, 'w': k.w}})), lambda s, k: {{'l': s.r, 'r': (s.l + ((((s.r * k.m + k.c) % {MODULUS}) * k.w + ((s.r * k.m + k.c) % {MODULUS}) // 65536) % {MODULUS}) % a) % a, 'm': 0::BIGINT, 'c': 0::BIGINT, 'w': 0::BIGINT}}))"
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END) AS c
    FROM range(256) r(i))),
sized AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS (
  SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, size - 1), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)), lambda c, b: xor(c // 256, t[(xor(c % 256, b))::INT + 1]))) AS text_crc32
  FROM sized, crc_table),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS x, count(*) OVER () AS n FROM summed),
based AS (SELECT *, ceil(sqrt(n))::BIGINT AS a FROM numbered),
walk AS (
  SELECT doc_id, size, text_crc32, n, a, x, 0 AS k FROM based
  UNION ALL
  SELECT doc_id, size, text_crc32, n, a, y.l * a + y.r, k + 1 FROM (SELECT *, {step} AS y FROM walk WHERE k = 0 OR x >= n))
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {SHARDS})::INT AS shard, (x // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard
FROM walk WHERE k > 0 AND x < n"""


ORACLE = {"op5_sharding": _oracle()}
