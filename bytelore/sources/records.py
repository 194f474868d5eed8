"""Compilation of registry records (one XML document per format, in a zip) into a registry."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cache
from urllib.parse import urlparse
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bytelore import schema
from bytelore.functions.bytesyntax import POSITIONS as POSITION_TYPES
from bytelore.functions.bytesyntax import IncompatibleSequence, compile_sequence, position_of
from bytelore.functions.batches import mapped
from bytelore.sources import single
from bytelore.sources.stored import stored

#: Namespace of the records, and the containers by format.
NAMESPACE = "{http://pronom.nationalarchives.gov.uk}"
CONTAINERS = {"x-fmt/263": "zip", "x-fmt/265": "tar"}


@cache
def _path(*names: str) -> str:
    return "/".join(NAMESPACE + n for part in names for n in part.split("/"))


def _get(element, name: str) -> str:
    found = element.find(_path(name))
    return (found.text or "").strip() if found is not None else ""


def _identifiers(element, child: str, web: Callable[[str], str]) -> list[str]:
    out = []
    for x in element.findall(_path(child)):
        kind, value = _get(x, "IdentifierType"), _get(x, "Identifier")
        out.append(web(value) if kind == "URL" else f"{kind}:{value}")
    return out


def _with_scheme(url: str) -> str:
    return url if urlparse(url).scheme else f"http://{url}"


def _signatures(record) -> tuple[list[tuple], list[str]]:
    """Signatures, and messages about dropped ones: an incompatible sequence drops those that were read before it, too."""
    out, messages = [], []
    for s in record.findall(_path("InternalSignature")):
        patterns = []
        try:
            for b in s.findall(_path("ByteSequence")):
                position, sequence = position_of(_get(b, "PositionType")), _get(b, "ByteSequenceValue")
                patterns.append((position, sequence, compile_sequence(sequence, position, _get(b, "Offset"), _get(b, "MaxOffset"))))
        except IncompatibleSequence as e:
            messages.append(f"incompatible: {e}")
            out.clear()
            continue
        note = _get(s, "SignatureNote")
        out.append((_get(s, "SignatureName"), [note] if note else [], patterns))
    return out, messages


def _details(record, checksum: Callable[[str], str]) -> tuple:
    related = lambda kind: [_get(x, "RelatedFormatID") for x in record.findall(_path("RelatedFormat")) if _get(x, "RelationshipType") == kind]
    references = [
        (_get(d, "TitleText"), _get(d, "Author/AuthorCompoundName"), _get(d, "Publisher/PublisherCompoundName"), _get(d, "PublicationDate"), _identifiers(d, "DocumentIdentifier", lambda u: "http://" + u),
         _get(d, "DocumentNote"), _get(d, "DocumentType"), f"{_get(d, 'AvailabilityDescription')} {_get(d, 'AvailabilityNote')}", _get(d, "DocumentIPR"))
        for d in record.findall(_path("Document"))
    ]
    examples = []
    for f in record.findall(_path("ReferenceFile")):
        names = _identifiers(f, "ReferenceFileIdentifier", _with_scheme)
        webs = [n for n in names if n.startswith(("http:", "https:"))]
        examples.append((_get(f, "ReferenceFileName"), _get(f, "ReferenceFileDescription"), names, "", _get(f, "ReferenceFileIPR"), checksum(webs[-1]) if webs else ""))
    about = ("unknown", _get(record, "ProvenanceName"), _get(record, "ProvenanceSourceDate"), _get(record, "LastUpdatedDate"), _get(record, "ProvenanceDescription"))
    return (
        _get(record, "FormatDescription"), _get(record, "ReleaseDate"), _get(record, "Developers/DeveloperCompoundName"), _get(record, "Developers/OrganisationName"),
        related("Is supertype of"), related("Is subtype of"), _get(record, "FormatTypes"), references, examples, about,
    )


def parse_record(xml: bytes | str, puid_filter: str | None = None, checksum: Callable[[str], str] = lambda url: "") -> tuple | None:
    """A row of the registry schema without its two ordinals; None for a record without puid or of another one."""
    record = ElementTree.fromstring(xml).find(_path("report_format_detail/FileFormat"))
    if record is None:
        return None
    puid, mime, uti = None, [], None
    for x in record.findall(_path("FileFormatIdentifier")):
        kind, value = _get(x, "IdentifierType"), _get(x, "Identifier")
        if kind == "PUID":
            puid = value
        elif kind == "MIME":
            mime.append(value)
        elif kind == "Apple Uniform Type Identifier":
            uti = value
    if puid is None or (puid_filter and puid != puid_filter):
        return None
    signatures, _ = _signatures(record)
    extensions = [_get(x, "Signature") for x in record.findall(_path("ExternalSignature"))]
    over = [_get(x, "RelatedFormatID") for x in record.findall(_path("RelatedFormat")) if _get(x, "RelationshipType") == "Has priority over"]
    return puid, mime, CONTAINERS.get(puid), _get(record, "FormatName"), _get(record, "FormatVersion"), _get(record, "FormatAliases"), _get(record, "FormatID"), extensions, uti, over, signatures, _details(record, checksum)


def _texts(df: DataFrame, run: Callable, out) -> DataFrame:
    """`run(ord, xml)` gives rows for each record of a table (ord, xml), in the tasks."""
    types = to_arrow_schema(out)

    def parse(batches):
        for batch in batches:
            rows = [r for ord_, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if xml for r in run(ord_, xml)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array([_plain(x, f.type) for x in c], f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    return mapped(df.select("ord", "xml"), parse, out)


def _plain(value, kind):
    """Tuples as the dictionaries that a struct is made of."""
    if isinstance(value, tuple) and pa.types.is_struct(kind):
        return {f.name: _plain(v, f.type) for f, v in zip(kind, value, strict=True)}
    if isinstance(value, list) and pa.types.is_list(kind):
        return [_plain(v, kind.value_type) for v in value]
    return value


def compiled_texts(df: DataFrame, puid: str | None = None, checksum: Callable[[str], str] = lambda url: "") -> DataFrame:
    """The registry of records given as texts (ord, xml), parsed by the tasks; as `compile_records` otherwise."""

    def run(ord_, xml):
        row = parse_record(xml, puid, checksum)
        return [(ord_, 0, *row)] if row else []

    formats = _texts(df, run, schema.FORMAT)
    return formats if puid else remapped(stored(formats))  # read three times, parsed once


def messages_of_texts(df: DataFrame) -> DataFrame:
    """(puid, message): what was dropped of each record (ord, xml)."""

    def run(_, xml):
        record = ElementTree.fromstring(xml).find(_path("report_format_detail/FileFormat"))
        row = parse_record(xml)
        return [(row[0], m) for m in _signatures(record)[1]] if row else []

    return _texts(df, run, T.StructType([T.StructField("puid", T.StringType()), T.StructField("message", T.StringType())]))


def fetched_checksum(fetch: Callable[[str], bytes]) -> Callable[[str], str]:
    """Checksums of example files by a function that fetches them; empty where that fails."""

    def checksum(url: str) -> str:
        try:
            return hashlib.md5(fetch(url)).hexdigest()
        except OSError:
            return ""

    return checksum


def compile_records(spark: SparkSession, archive: str, puid: str | None = None, checksum: Callable[[str], str] = lambda url: "") -> DataFrame:
    """The registry of a zip of records (path or URI), in the order of the zip; priorities by id become puids where the id is known.

    Tasks read and parse ranges of the zip. With `puid` only that format is compiled, and its priorities keep their ids.
    """
    return compiled_texts(single.read_zip(spark, archive).select("ord", F.col("content").alias("xml")), puid, checksum)


def remapped(formats: DataFrame) -> DataFrame:
    """Formats whose inferior ids are replaced by puids; unknown ids stay as they are."""
    edges = formats.select("puid", F.posexplode("has_priority_over").alias("at", "id"))
    known = formats.groupBy(F.col("pronom_id").alias("id")).agg(F.min_by("puid", "ord").alias("target"))
    lists = edges.join(known, "id", "left").groupBy("puid").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("target", "id").alias("to")))).alias("a")).select("puid", F.col("a.to").alias("mapped"))
    joined = formats.join(lists, "puid", "left")
    return joined.withColumn("has_priority_over", F.coalesce("mapped", F.array().cast("array<string>"))).select(*formats.columns)
