"""Rows with the rows before and after them in a global order, without a window over one partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelore.llm.common import mapped, stored

Row = tuple
BATCH = 512
BEFORE, OWN, AFTER = 0, 1, 2


def _triples(rows: Iterator[Row]) -> Iterator[tuple[Row | None, Row, Row | None]]:
    before, here = None, next(rows, None)
    while here is not None:
        after = next(rows, None)
        yield before, here, after
        before, here = here, after


def _rows(batches) -> Iterator[Row]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def with_neighbours(df: DataFrame, order: list[str], schema: T.StructType, make: Callable[[Row | None, Row, Row | None], Row], around: bool = False) -> DataFrame:
    """`make(before, row, after)` for every row in the order of `order`; `around`: the last row is before the first.

    The rows are range-partitioned and sorted, so each task works on its range and holds three rows at a time. The two rows
    at each end of a range are kept with the number of their partition; the first and the last then also go to the partition
    beside, and every partition settles its own two ends from six rows at most, in groups that are dealt out like any other.
    The first pass is written to the shared folder: numbers of partitions then hold, even if an executor is lost.
    """
    fields = df.schema.fields
    raw = T.StructType([T.StructField(f"_raw_{f.name}", f.dataType, True) for f in fields])
    marks = [T.StructField("_part", T.IntegerType()), T.StructField("_seq", T.LongType()), T.StructField("_last", T.BooleanType())]
    both = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in schema.fields], *marks, *raw.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    made_types, all_types = to_arrow_schema(schema), to_arrow_schema(both)
    n_made, n_raw = len(schema.fields), len(fields)

    def packed(rows: list[Row], types: pa.Schema) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in types]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    def inside(batches):
        part, out = TaskContext.get().partitionId(), []
        held: list[tuple[int, Row]] = []  # the last two rows, in case they end the range
        for seq, (before, row, after) in enumerate(_triples(_rows(batches))):
            if before is not None and after is not None:
                out.append((*make(before, row, after), None, None, None, *[None] * n_raw))
            if seq < 2:
                out.append((*[None] * n_made, part, seq, after is None, *row))
            else:
                held = [*held[-1:], (seq, row)]
            if after is None and held:
                out += [(*[None] * n_made, part, s, s == seq, *r) for s, r in held]
            if len(out) >= BATCH:
                yield packed(out, all_types)
                out = []
        yield packed(out, all_types)

    def settled(group: list[Row]) -> Iterator[Row]:
        for before, row, after in _triples(iter(group)):
            _, place, seq, last = row[:4]
            if place == OWN and (seq == 0 or last):
                yield make(before and before[4:], row[4:], after and after[4:])

    def between(batches):
        group, rows = [], []
        for r in _rows(batches):
            if group and group[0][0] != r[0]:
                rows += settled(group)
                group = []
                if len(rows) >= BATCH:
                    yield packed(rows, made_types)
                    rows = []
            group.append(r)
        yield packed([*rows, *settled(group)], made_types)

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    whole = stored(mapped(ranged, inside, both))
    done = whole.where("_part IS NULL").select(*schema.names)
    ends = whole.where("_part IS NOT NULL").select("_part", "_seq", "_last", *raw.names)
    parts, line = ends.select("_part").distinct(), Window.orderBy("_part")  # as many rows as partitions
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    previous, following = F.lag("_part").over(line), F.lead("_part").over(line)
    if around:
        previous, following = F.coalesce(previous, F.max("_part").over(every)), F.coalesce(following, F.min("_part").over(every))
    beside = F.broadcast(stored(parts.select("_part", previous.alias("_previous"), following.alias("_following"))))
    sent = lambda rows, to, place: rows.select(F.col(to).alias("_to"), F.lit(place).alias("_place"), "_seq", "_last", *raw.names)
    near = ends.join(beside, "_part")
    groups = sent(ends, "_part", OWN).unionByName(sent(near.where("_last AND _following IS NOT NULL"), "_following", BEFORE)).unionByName(sent(near.where("_seq = 0 AND _previous IS NOT NULL"), "_previous", AFTER))
    return done.unionByName(mapped(groups.repartition("_to").sortWithinPartitions("_to", "_place", "_seq"), between, schema))
