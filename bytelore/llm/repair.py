"""Operator 12: repair of the turns of conversations by a scan of min-plus matrices.

A repaired conversation has the roles `(s?(ua)+)?`, by initials: an optional system turn, then user and assistant by turns, or
nothing. Its states are start, after s, after u and after a. Every turn is a 4x4 matrix from state to state: inserts first
(their closure), then one edit of the turn. An entry is (cost, audit), the cheapest way and its edits' initials; the product
takes the least by cost, then by ASCII. That choice is safe in every part of a conversation: two ways through the same turns
at the same cost are never prefixes of one another, as the longer one would have inserts more. So the product is associative:
tasks multiply what they hold of a conversation as a balanced tree, and what a task's range cuts is multiplied by further
rounds of a tree whose groups have FAN elements at most.

Inside, a required delete is D and a chosen one E (both sort before I, K and R, and never compete with one another); the audit
shows D for both. Audits without the required deletes line up with the turns that are neither blank nor repeated, which are
all the turns whose texts are needed.

Order of turns: turn (nulls first), then role, the first HEAD characters of the text, and its MD5; rows that are equal in all
of these are copies, counted before anything is shuffled. Null id, turn, role or text: read as one space, but for the order,
gaps and the returned id. A role whose initial is none of s, u, a, or that is empty, can't be kept. Turns are read as whole
numbers. Other columns are not looked at. A conversation of any length is scanned across partitions; only the lines of its
repaired text pass through one task, in order and one at a time, as a hash of all of them has to.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bytelore.llm.common import mapped, spark_schema, stored, table

HEAD = 64
FAN = 16
OUT_ROWS = 200  # of a batch of results
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs; the last is added to a truncated turn that is not deleted
START, AFTER_S, AFTER_U, AFTER_A = range(4)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

Entry = tuple[int, str] | None
Matrix = tuple[Entry, ...]


def _matrix(entries: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(entries.get((i, j)) for i in range(4) for j in range(4))


IDENTITY = _matrix({(i, i): (0, "") for i in range(4)})
_NAMES = {AFTER_U: "user", AFTER_A: "assistant"}
_STEP = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}  # where a user or assistant turn leads


def product(a: Matrix, b: Matrix) -> Matrix:
    out: list[Entry] = []
    for i in range(0, 16, 4):
        row = [(k, e) for k, e in enumerate(a[i : i + 4]) if e is not None]
        for j in range(4):
            best, ways = -1, []
            for k, (cost, audit) in row:
                after = b[4 * k + j]
                if after is None:
                    continue
                total = cost + after[0]
                if best < 0 or total < best:
                    best, ways = total, [(audit, after[1])]
                elif total == best:
                    ways.append((audit, after[1]))
            out.append((best, min(x + y for x, y in ways)) if ways else None)
    return tuple(out)


def _closure() -> Matrix:
    """Inserts, as many as are needed: further ones only cost more."""
    step = {(i, j): (INSERT, "I") for i, j in _STEP.items()}
    one = _matrix({(i, i): (0, "") for i in range(4)} | step)
    return product(one, one)


CLOSURE = _closure()


def leaf(initial: str, forced: bool, truncated: bool) -> Matrix:
    """Inserts, then one edit of a turn."""
    if forced:
        return product(CLOSURE, _matrix({(i, i): (DELETE, "D") for i in range(4)}))
    more = TRUNCATED if truncated else 0
    ways: dict[tuple[int, int], tuple[int, str]] = {(i, i): (DELETE, "E") for i in range(4)}
    ways |= {(i, j): (REROLE + more, "R") for i, j in _STEP.items()}
    kept = {"s": [(START, AFTER_S)], "u": [(i, j) for i, j in _STEP.items() if j == AFTER_U], "a": [(AFTER_U, AFTER_A)]}
    ways |= {edge: (KEEP + more, "K") for edge in kept.get(initial, ())}
    return product(CLOSURE, _matrix(ways))


_LEAVES = {(c, f, t): leaf(c, f, t) for c in ("s", "u", "a", "") for f in (False, True) for t in (False, True)}
_LEGAL = {"su", "ua", "au"}

# What is known of some neighbouring turns: least and greatest turn, distinct turns, first and last initial, counts of illegal
# neighbours, blank, repeated and truncated turns, and the matrix. An empty first initial stands for one that is no letter of
# a role; None: no turns at all.
Part = tuple
EMPTY: Part = (None, None, 0, None, None, 0, 0, 0, 0, IDENTITY)


def joined(a: Part, b: Part) -> Part:
    if b[3] is None:
        return a
    if a[3] is None:
        return b
    least = a[0] if a[0] is not None else b[0]
    most = b[1] if b[1] is not None else a[1]
    shared = a[1] is not None and a[1] == b[0]
    return (least, most, a[2] + b[2] - shared, a[3], b[4], a[5] + b[5] + (a[4] + b[3] not in _LEGAL), a[6] + b[6], a[7] + b[7], a[8] + b[8], product(a[9], b[9]))


def turns_alike(turn: int | None, initial: str, copies: int, blank: bool, seen: bool, truncated: bool) -> Part:
    """`copies` equal turns, of which the first is no repetition unless it was `seen` before."""
    counted = int(turn is not None)

    def one(forced: bool, *faults: int) -> Part:
        return (turn, turn, counted, initial, initial, 0, *faults, _LEAVES[initial, forced, truncated and not forced])

    again = one(True, 1, 0, 0) if blank else one(True, 0, 1, 0)
    if blank or seen:
        return _power(again, copies)
    first = one(False, 0, 0, int(truncated))
    return joined(first, _power(again, copies - 1))


def _power(part: Part, n: int) -> Part:
    out = EMPTY
    while n:
        if n & 1:
            out = joined(part, out)
        n >>= 1
        if n:
            part = joined(part, part)
    return out


class _Tree:
    """A balanced product of parts as they come: neighbours of equal size are joined at once."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, Part]] = []

    def add(self, part: Part) -> None:
        size = 1
        while self.stack and self.stack[-1][0] == size:
            part = joined(self.stack.pop()[1], part)
            size *= 2
        self.stack.append((size, part))

    def total(self) -> Part:
        out = EMPTY
        while self.stack:
            out = joined(self.stack.pop()[1], out)
        return out


def settled(part: Part) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, audit without required deletes) of a whole conversation."""
    least, most, distinct, _, _, illegal, blank, duplicate, truncated, matrix = part
    whole = product(matrix, CLOSURE)
    cost, audit = min(e for e in (whole[START], whole[AFTER_A]) if e is not None)
    gaps = most - least + 1 - distinct if distinct else 0
    return gaps, blank, duplicate, truncated, illegal, cost, audit.replace("E", "D"), audit.replace("D", "")


SPACE = " \t\n\x0b\f\r"


def _read(conversations: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    space = F.lit(" ")
    return conversations.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"), F.coalesce(F.col(text).cast("string"), space).alias("text"),
        (F.lit(1) if copies is None else F.col(copies)).cast("long").alias("copies"),
    )


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with what orders them, their faults and initials."""
    said = F.btrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    return rows.withColumns({
        "head": F.substring("text", 1, HEAD), "digest": F.md5("text"), "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("")),
        "blank": said == "", "truncated": ~F.substring(said, -1, 1).isin(".", "!", "?"),
    })


_ORDER = ["conv", "turn", "role", "head", "digest"]  # nulls first, as Spark sorts


def repaired(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, marks) of every conversation.

    `copies` names a column of how often a row stands there; rows of 0 copies only name their conversation. `marks` is the
    audit without the required deletes, with E for a chosen one: a letter for each turn of `repaired_turns`' own reading.
    """
    rows = _placed(_read(conversations, conv, turn, role, text, copies)).drop("text")
    alike = rows.groupBy("conv", "turn", "role", "head", "digest", "initial", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    there = alike.where("copies > 0").groupBy("conv", "role", "digest").agg(F.min("turn").alias("least"), F.bool_or(F.isnull("turn")).alias("at_null"))
    of = there.withColumnsRenamed({"conv": "of_conv", "role": "of_role", "digest": "of_digest"})
    same = F.col("conv").eqNullSafe(F.col("of_conv")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest"))
    seen = F.coalesce(F.isnotnull("turn") & (F.col("at_null") | (F.col("least") < F.col("turn"))), F.lit(False))
    turns = alike.join(of, same, "left").select("conv", "turn", "role", "head", "digest", "initial", "copies", "blank", seen.alias("seen"), "truncated")
    ranged = turns.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select("conv", "turn", "initial", "copies", "blank", "seen", "truncated")
    of_conv = T.StructField("conv", ranged.schema["conv"].dataType)
    done = T.StructType([of_conv, *spark_schema(*[(c, "bigint") for c in COUNTS], ("audit", "string"), ("marks", "string")).fields])
    pieces = T.StructType([of_conv, *spark_schema(("part", "int"), ("piece", "binary")).fields])
    both = T.StructType([*done.fields, *pieces.fields[1:]])
    made = stored(mapped(ranged, _scanner(both), both))
    cut = made.where("piece IS NOT NULL").select(*pieces.names)  # two at most of each partition
    parts = cut.agg(F.max("part")).first()[0] or 0
    while parts >= FAN:
        cut, parts = _level(cut, pieces), parts // FAN
    return made.where("piece IS NULL").select(*done.names).unionByName(_level(cut, done))


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _packed(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Batches of some rows each, and an empty one at the end."""
    types = to_arrow_schema(schema)
    while True:
        some = list(islice(rows, OUT_ROWS))
        columns = zip(*some, strict=True) if some else [[] for _ in types]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)
        if not some:
            return


def _scanner(schema: T.StructType):
    """Conversations inside a range are settled; the first and the last of a range are handed on."""

    def scan(batches) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()

        def found() -> Iterator[tuple]:
            last = None
            for place, (conv, turns) in enumerate(groupby(_rows(batches), lambda r: r[0])):
                if last is not None:
                    yield (last[0], *settled(last[1]), None, None)
                tree = _Tree()
                for _, turn, initial, copies, blank, seen, truncated in turns:
                    if copies:
                        tree.add(turns_alike(turn, initial, copies, blank, seen, truncated))
                last = conv, tree.total()
                if not place:
                    yield (conv, *[None] * (len(COUNTS) + 2), number, pickle.dumps(last[1]))
                    last = None
            if last is not None:
                yield (last[0], *[None] * (len(COUNTS) + 2), number, pickle.dumps(last[1]))

        yield from _packed(found(), schema)

    return scan


def _level(cut: DataFrame, schema: T.StructType) -> DataFrame:
    """Pieces of a conversation multiplied in their order: FAN at most of a conversation each, or, for results, what is left of it."""
    last = "piece" not in schema.names

    def multiplied(batches) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (conv, group), pieces in groupby(_rows(batches), lambda r: r[:2]):
                tree = _Tree()
                for _, _, _, piece in pieces:
                    tree.add(pickle.loads(piece))
                yield (conv, *settled(tree.total())) if last else (conv, group, pickle.dumps(tree.total()))

        yield from _packed(found(), schema)

    group = F.lit(0) if last else (F.col("part") / FAN).cast("int")
    dealt = cut.select("conv", group.alias("group"), "part", "piece").repartition("conv", "group").sortWithinPartitions("conv", "group", "part")
    return mapped(dealt, multiplied, schema)


def repaired_turns(conversations: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """(conv, place, role, text, edit) of the turns of repaired conversations, by the marks that `repaired` found.

    Each partition has its conversations one after the other, in order; a conversation is read as it streams by, a turn at a time.
    """
    rows = _read(conversations, conv, turn, role, text, copies).where("copies > 0")
    first = rows.groupBy("conv", "role", "text").agg(F.min("turn").alias("least"), F.bool_or(F.isnull("turn")).alias("at_null"))
    first = first.withColumn("turn", F.when(~F.col("at_null"), F.col("least")))
    first = _placed(first).where(~F.col("blank")).select("conv", F.lit(1).alias("what"), "turn", "role", "head", "digest", "text")
    none = F.lit(None)
    marks = found.where(F.length("marks") > 0).select("conv", F.lit(0).alias("what"), none.cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("head"), F.lit("").alias("digest"), F.col("marks").alias("text"))
    dealt = marks.unionByName(first).repartition("conv").sortWithinPartitions("conv", "what", *_ORDER[1:])
    schema = T.StructType([T.StructField("conv", dealt.schema["conv"].dataType), *spark_schema(("place", "bigint"), ("role", "string"), ("text", "string"), ("edit", "string")).fields])

    def edited(batches) -> Iterator[pa.RecordBatch]:
        yield from _packed(_edited(_rows(batches)), schema)

    return mapped(dealt.select("conv", "what", "role", "text"), edited, schema)


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, turns in groupby(rows, lambda r: r[0]):
        state, place, at, marks = START, 0, 0, ""
        for _, what, role, text in turns:
            if not what:
                marks = text
                continue
            while marks[at] == "I":
                state = _STEP[state]
                yield conv, place, _NAMES[state], "", "insert"
                at, place = at + 1, place + 1
            edit, at = marks[at], at + 1
            if edit == "E":
                continue
            state = AFTER_S if edit == "K" and role[:1] == "s" else _STEP[state]
            yield conv, place, role if edit == "K" else _NAMES[state], text, "keep" if edit == "K" else "rerole"
            place += 1
        for _ in marks[at:]:
            state = _STEP[state]
            yield conv, place, _NAMES[state], "", "insert"
            place += 1


def digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of what `repaired_turns` returned, as it returned it: `role:text`, joined by newlines."""
    schema = T.StructType([turns.schema["conv"], *spark_schema(("repaired_sha256", "string")).fields])

    def hashed(batches) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for conv, lines in groupby(_rows(batches), lambda r: r[0]):
                total = hashlib.sha256()
                for _, place, role, text, _ in lines:
                    total.update(f"{chr(10) if place else ''}{role}:{text}".encode())
                yield conv, total.hexdigest()

        yield from _packed(found(), schema)

    return mapped(turns, hashed, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): a row in five damaged by the checksum of its id and turn."""
    space = F.lit(" ")
    read = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(read("conv_id"), F.lit(":"), read("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(read("text"), ".!?", "")).otherwise(read("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(read("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair; see the module."""
    rows = damaged(table(spark, sf_dir, "conversations"))
    found = stored(repaired(rows, copies="copies"))
    hashes = digests(repaired_turns(rows, found, copies="copies")).withColumnRenamed("conv", "of_conv")
    out = found.join(hashes, F.col("conv").eqNullSafe(F.col("of_conv")), "left")
    return out.select(F.col("conv").alias("conv_id"), *COUNTS[:-1], "cost", "audit", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
