"""Matching of objects against a registry, as DataFrame operators."""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from bytelore import schema
from bytelore.functions.batches import mapped
from bytelore.operators.registry import OLE_PUID, Compiled, extension_table, literal, loaded


def windows(content: Column | str, size: int = schema.BUFFER) -> tuple[Column, Column]:
    """First and last `size` bytes of a binary column; whole if it is shorter."""
    content = F.col(content) if isinstance(content, str) else content
    return F.substring(content, 1, size), F.when(F.octet_length(content) > size, F.substring(content, -size, size)).otherwise(content)


def objects(df: DataFrame, object_id: str, filename: str, content: str, size: int = schema.BUFFER) -> DataFrame:
    """Objects out of a table with a binary column."""
    bof, eof = windows(content, size)
    return df.select(F.col(object_id).cast("string").alias("object_id"), F.col(filename).alias("filename"), F.octet_length(content).cast("long").alias("size"), bof.alias("bof"), eof.alias("eof"))


def with_candidates(df: DataFrame, registry: Compiled) -> DataFrame:
    """`candidates`: for each object all formats of which a signature holds, in registry order; `time_ms`: time spent on it; `note`: errors.

    One crossing to Python per object; windows go in, only the matches come out.
    """
    packed = pickle.dumps(registry)
    kept = [c for c in df.columns if c not in ("bof", "eof")]
    at = [df.columns.index(c) for c in kept]
    bof, eof = df.columns.index("bof"), df.columns.index("eof")
    kind = to_arrow_type(T.ArrayType(schema.CANDIDATE))

    def run(batches):
        from time import perf_counter

        own = loaded(packed)
        for batch in batches:
            found, times, notes = [], [], []
            for b, e in zip(batch.column(bof), batch.column(eof), strict=True):
                began = perf_counter()
                errors: list[str] = []
                hits = own.candidates(b.as_py() or b"", e.as_py() or b"", errors)
                notes.append("; ".join(errors) or None)
                found.append(own.described(hits))
                times.append(int((perf_counter() - began) * 1000))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), pa.array(found, kind), pa.array(times, pa.int64()), pa.array(notes, pa.string())], names=[*kept, "candidates", "time_ms", "note"])

    fields = {f.name: f for f in df.schema.fields}
    out = T.StructType([*(fields[c] for c in kept), T.StructField("candidates", T.ArrayType(schema.CANDIDATE)), T.StructField("time_ms", T.LongType()), T.StructField("note", T.StringType())])
    return mapped(df, run, out)


_OVER = "exists({list}, y -> y.puid <> x.puid AND array_contains(y.prio, x.puid))"


def resolved(candidates: str = "candidates") -> Column:
    """Order-sensitive suppression of an array of candidates, with built-in functions."""
    kind = schema.CANDIDATE.simpleString()
    fold = f"aggregate({candidates}, CAST(array() AS array<{kind}>), (acc, x) -> IF({_OVER.format(list='acc')}, acc, array_append(acc, x)))"
    return F.expr(f"transform(array({fold}), a -> filter(a, x -> NOT {_OVER.format(list='a')}))[0]")


def native_holds(position: str, regex: str, bof: str = "bof", eof: str = "eof") -> Column:
    """A pattern as a built-in predicate over Latin-1 text, for small registries of patterns without repeated groups.

    Bytes at a fixed place are compared first, so most rows are not decoded.
    """
    java = regex.encode().decode("latin-1").replace("\\Z", "\\z")
    if position == "BOF":
        java = f"\\A(?:{java})"
    elif position not in ("EOF", "VAR", "IFB"):
        return F.lit(True)
    test = F.regexp_like(F.decode(F.col(eof if position == "EOF" else bof), "ISO-8859-1"), F.lit(java))
    fixed = literal(regex) if position == "BOF" else None
    return (F.substring(F.col(bof), fixed[0] + 1, len(fixed[1])) == F.lit(fixed[1])) & test if fixed else test


def native_candidates(df: DataFrame, registry: Compiled) -> DataFrame:
    """As `with_candidates`, without leaving the JVM: every signature is a predicate of the row. A check, and a plan for a few dozen formats."""
    entries = []
    for ord_, puid, _, prio, signatures, _ in registry.formats:
        sigs = []
        for k, (name, patterns) in enumerate(signatures):
            test = F.lit(True)
            for position, regex in patterns:
                test = test & native_holds(position, regex)
            sigs.append(F.when(test, F.struct(F.lit(k).alias("sig_ord"), F.lit(name).alias("name"))))
        if sigs:
            hit = F.filter(F.array(*sigs), lambda s: s.isNotNull())
            entries.append(F.struct(F.lit(ord_).alias("ord"), F.lit(puid).alias("puid"), F.array(*[F.lit(p) for p in sorted(prio)]).cast("array<string>").alias("prio"), hit.alias("sigs")))
    found = F.filter(F.array(*entries), lambda c: F.size(c["sigs"]) > 0) if entries else F.array().cast(T.ArrayType(schema.CANDIDATE))
    return df.withColumn("candidates", found).withColumn("time_ms", F.lit(0).cast("long")).drop("bof", "eof")


def extension_matches(formats: DataFrame) -> DataFrame:
    """(ext, ext_matches): what `by_extension` finds for each extension; as many rows as extensions."""
    prio = formats.select("puid", F.coalesce("has_priority_over", F.array().cast("array<string>")).alias("prio"))
    grouped = extension_table(formats).join(prio, "puid").groupBy("ext").agg(F.sort_array(F.collect_list(F.struct("ord", "puid", "prio"))).alias("found"))
    kept = F.expr("filter(found, x -> NOT exists(found, y -> y.puid <> x.puid AND array_contains(y.prio, x.puid)))")
    external = F.array(F.struct(F.lit(0).alias("sig_ord"), F.lit("External").alias("name")))
    return grouped.select("ext", F.transform(kept, lambda c: F.struct(c["ord"].alias("ord"), c["puid"].alias("puid"), c["prio"].alias("prio"), external.alias("sigs"))).alias("ext_matches"))


def container_type(matches: Column | str, formats: list[tuple]) -> Column:
    """Container kind of the first match that has one."""
    kinds = {f[0]: f[2] or "ole" for f in formats if f[2] or f[1] == OLE_PUID}
    if not kinds:
        return F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.get(F.filter(F.transform(matches, lambda m: table[m["ord"]]), lambda k: k.isNotNull()), F.lit(0))
