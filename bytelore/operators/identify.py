"""Identification: signatures, containers, extensions and archive members, up to result rows."""

from __future__ import annotations

import io
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import islice
from time import perf_counter
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bytelore import schema
from bytelore.functions.batches import mapped
from bytelore.functions.names import extension_column
from bytelore.operators import matching
from bytelore.operators.registry import OLE, TAR, ZIP, Compiled, compiled, loaded, small
from bytelore.sources.archives import BROKEN, container_hits, members, range_members, ranges
from bytelore.sources.store import created, windows_of
from bytelore.sources.store import opened as opened_file
from bytelore.sources.stored import shared_dir, stored

MATCHES = T.ArrayType(schema.CANDIDATE)
#: What a task finds out about an object or a member: its matches after suppression, and messages about what could not be read.
SCANNED = T.StructType([T.StructField("object_id", T.StringType()), T.StructField("filename", T.StringType()), T.StructField("size", T.LongType()), T.StructField("time_ms", T.LongType()), T.StructField("chosen", MATCHES), T.StructField("label", T.StringType()), T.StructField("path", T.StringType()), T.StructField("note", T.StringType())])


@dataclass
class Options:
    """What the command line offers: window size, extension fallback, deep scan, members of archives."""

    bufsize: int = schema.BUFFER
    container_bufsize: int = schema.CONTAINER_BUFFER  # accepted; the registered members of containers are read whole
    extension: bool = True
    containers: bool = True
    archives: bool = False
    split: bool = False  # members of one archive are dealt to many tasks; of files only


#: A part of an archive: where it can be read, its kind, regular members before, place of its first entry, entries.
PARTS = T.ArrayType(T.StructType([T.StructField("before", T.LongType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType())]))
SPLIT = T.StructType([*SCANNED.fields, T.StructField("uri", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("parts", PARTS)])


@dataclass
class FormatIdentifier:
    """Identifies objects by a registry of formats (and, for deep scans, of container signatures)."""

    spark: SparkSession
    formats: DataFrame
    containers: DataFrame | None = None
    options: Options = field(default_factory=Options)

    def __post_init__(self):
        self._compiled: Compiled | None = None

    @property
    def registry(self) -> Compiled:
        if self._compiled is None:
            self._compiled = compiled(self.formats, self.containers)
        return self._compiled

    def matches(self, objects: DataFrame) -> DataFrame:
        """`objects` (object_id, filename, size, bof, eof and more) with `matches` after suppression, `time_ms` and `note`."""
        found = matching.with_candidates(objects, self.registry)
        return found.withColumn("matches", matching.resolved()).drop("candidates")

    def content(self, df: DataFrame, object_id: str = "object_id", filename: str = "filename", content: str = "content", stream: bool = False) -> DataFrame:
        """Results for a table with a binary column.

        Only windows go to Python if neither containers nor archives are looked into; else each content goes there once.
        """
        rows = df.select(F.col(object_id).cast("string").alias("object_id"), F.col(filename).alias("filename"), F.coalesce(F.col(content), F.lit(b"")).alias("content"))
        if stream or not (self.options.containers or self.options.archives):
            bof, eof = matching.windows("content", self.options.bufsize)
            return self.objects(rows.withColumns({"size": F.octet_length("content").cast("long"), "bof": bof, "eof": eof}).drop("content"), stream)
        n = self.options.bufsize

        def given(batch):
            for object_id, name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = data.as_py() or b""
                yield object_id, name, lambda data=data: (len(data), data[:n], data[-n:] if n else b""), lambda data=data: io.BytesIO(data)

        return self._rows(self._scanned(rows, given))

    def objects(self, objects: DataFrame, stream: bool = False, extension_of: str = "filename") -> DataFrame:
        """Results for objects given by their windows alone: no deep scan, no members. `extension_of`: the column whose extension counts."""
        found = self.matches(objects)
        signed = (F.size("matches") > 0) & (F.lit(stream) | (F.col("size") > 0))
        if self.options.extension:
            table = small(matching.extension_matches(self.formats), len(self.registry.formats))
            found = found.withColumn("ext", extension_column(extension_of)).join(table, "ext", "left").drop("ext")
        else:
            found = found.where(signed).withColumn("ext_matches", F.lit(None).cast(MATCHES))
        chosen = F.when(signed, F.col("matches")).otherwise(F.coalesce("ext_matches", F.array().cast(MATCHES)))
        return self._rows(found.select("object_id", "filename", "size", "time_ms", chosen.alias("chosen"), F.when(signed, "signature").otherwise("extension").alias("label"), F.lit("").alias("path"), "note"))

    def files(self, paths: DataFrame) -> DataFrame:
        """Results for files, out of a table with their names in a column `path`; paths or URIs. Executors open them, and read of each what is looked at."""
        n = self.options.bufsize

        def given(batch):
            for path in batch.column(0).to_pylist():
                yield path, path, lambda path=path: windows_of(path, n), lambda path=path: opened_file(path)

        split = self.options.archives and self.options.split
        scanned = self._scanned(paths.select(F.col("path").cast("string").alias("path")), given, split)
        return self._rows(self._levels(scanned) if split else scanned)

    def _scanned(self, df: DataFrame, given: Callable, split: bool = False) -> DataFrame:
        """Rows of SCANNED for each object and, if asked for, its members: windows, deep scan and members in one visit; or of SPLIT, with the parts of archives."""
        packed, o = pickle.dumps(self.registry), replace(self.options, split=split)
        kind = SPLIT if split else SCANNED

        def run(batches):
            own = loaded(packed)
            for batch in batches:
                yield from _packed(((object_id, *r) for object_id, name, windows, opened in given(batch) for r in scan(name, windows, opened, own, o)), kind)

        return mapped(df, run, kind)

    def _levels(self, scanned: DataFrame) -> DataFrame:
        """Objects and the members of archives, a level of nesting at a time: parts of archives are dealt to all tasks.

        Archives among the members are copied to a folder that all tasks share, and are files of the next level; an archive that
        holds itself is never finished. Each level is written once.
        """
        packed, o, folder = pickle.dumps(self.registry), self.options, shared_dir(self.spark)

        def run(batches):
            own = loaded(packed)
            for batch in batches:
                for r in batch.to_pylist():
                    try:
                        with opened_file(r["uri"]) as source:
                            found = range_members(r["filename"], source, r["kind"], r["path"], (r["before"], r["at"], r["n"]), own, o, lambda parts: _kept(folder, parts))
                            yield from _packed(((r["object_id"], *m) for m in found), SPLIT)
                    except BROKEN as e:
                        yield from _packed(iter([(r["object_id"], r["filename"], 0, 0, [], "fail", r["path"] + f"{r['before'] + 1:08d}/", str(e), None, None, [])]), SPLIT)

        level, whole = stored(scanned), None
        while True:
            rows = level.select(*SCANNED.names)
            whole = rows if whole is None else whole.unionByName(rows)
            parts = level.where("uri IS NOT NULL").select("object_id", "filename", "path", "uri", "kind", F.explode("parts").alias("part")).select("object_id", "filename", "path", "uri", "kind", "part.*")
            n = parts.count()
            if not n:
                return whole
            level = stored(parts.repartition(min(n, self.spark.sparkContext.defaultParallelism * 16)).mapInArrow(run, SPLIT))

    def _rows(self, found: DataFrame) -> DataFrame:
        """Result rows: one for each signature of each match, or one KO row."""
        hits = F.flatten(F.transform("chosen", lambda m: F.transform(m["sigs"], lambda s: F.struct(m["ord"].alias("ord"), s["name"].alias("signaturename")))))
        rows = found.withColumn("hits", hits).withColumn("group_size", F.size("hits")).select("*", F.posexplode_outer("hits").alias("pos", "hit"))
        facts = self.formats.select(F.col("ord").alias("_ord"), "puid", F.col("name").alias("formatname"), F.get("mime", F.lit(0)).alias("mimetype"), "version", "alias", "apple_uti")
        rows = rows.join(small(facts, len(self.registry.formats)), F.col("hit.ord") == F.col("_ord"), "left")
        no = F.col("hit").isNull()
        return rows.select(
            "object_id", F.when(no, "KO").otherwise("OK").alias("status"), "time_ms", "puid", "formatname", F.coalesce("hit.signaturename", F.when(F.col("label") == "container", F.col("formatname"))).alias("signaturename"), F.col("size").alias("filesize"), "filename", "mimetype",
            F.when(no, "fail").otherwise(F.col("label")).alias("matchtype"), "version", "alias", "apple_uti", "group_size", (F.col("pos") + 1).alias("group_index"), "path", "note",
        )


def _packed(rows: Iterator[tuple], kind: T.StructType) -> Iterator[pa.RecordBatch]:
    types = to_arrow_schema(kind)
    while True:
        some = list(islice(rows, 1000))
        columns = list(zip(*some, strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array([_plain(x, f.type) for x in c], f.type) for c, f in zip(columns, types, strict=True)], schema=types)
        if not some:
            return


def _plain(value, kind: pa.DataType):
    """Tuples in a list as dictionaries, which structs are made of."""
    if isinstance(value, list) and value and isinstance(value[0], tuple):
        names = [f.name for f in kind.value_type]
        return [dict(zip(names, x, strict=True)) for x in value]
    return value


def _kept(folder: str, parts: Iterator[bytes]) -> str:
    """The URI of a new file with these bytes."""
    uri = f"{folder}/{uuid.uuid4().hex}"
    with created(uri) as f:
        for piece in parts:
            f.write(piece)
    return uri


def scan(name: str, windows: Callable[[], tuple[int, bytes, bytes]], opened: Callable[[], BinaryIO], own: Compiled, o: Options) -> list[tuple]:
    """(filename, size, time_ms, chosen, label, path, note) of an object and its members; a file that can't be opened has no row. With `split`, of a file
    alone, and (uri, kind, parts), which stand for its members."""
    began, notes = perf_counter(), []
    try:
        size, bof, eof = windows()
    except OSError:
        return []
    hits = own.resolve(own.candidates(bof, eof, notes))
    kind = own.container_type([i for i, _ in hits])
    deep, inside, parts = [], [], []
    if o.containers and own.containers and kind in (ZIP, OLE):
        with opened() as source:
            found = container_hits(source, "ZIP" if kind == ZIP else "OLE2", own.containers, notes)
        deep = [(own.by_puid[p], [(k, None)]) for k, p in enumerate(found) if p in own.by_puid]
    if deep:
        hits, label = deep, "container"
    elif hits and size > 0:
        label = "signature"
    else:
        hits, label = [(i, [(0, "External")]) for i in own.by_extension(name)] if o.extension else [], "extension"
    took = int((perf_counter() - began) * 1000)
    if o.archives and not deep:
        kind = own.container_type([i for i, _ in hits])
        if kind in (ZIP, TAR):
            try:
                with opened() as source:
                    if o.split:
                        parts = ranges(source, kind)
                    else:
                        inside = members(name, source, kind, own, o, notes)
            except BROKEN as e:
                notes.append(f"{name}: {e}")
    rows = [(*member, None) for member in inside]
    if hits or o.extension:
        rows.insert(0, (name, size, took, own.described(hits), label, "", "; ".join(notes) or None))
    if o.split:
        return [(*r, *((name, kind, parts) if parts else (None, None, []))) for r in rows]
    return rows
