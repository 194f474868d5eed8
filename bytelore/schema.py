"""Schemas of registries, objects, matches and results."""

from pyspark.sql import types as T

_text = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n.replace("__", ":"), t, True) for n, t in fields.items()])


PATTERN = _struct(position=_text, pronom_pattern=_text, regex=_text)
SIGNATURE = _struct(name=_text, note=T.ArrayType(_text), pattern=T.ArrayType(PATTERN))
REFERENCE = _struct(dc__title=_text, dc__creator=_text, dc__publisher=_text, dcterms__available=_text, dc__identifier=T.ArrayType(_text), dc__description=_text, dc__type=_text, dcterms__license=_text, dc__rights=_text)
EXAMPLE = _struct(dc__title=_text, dc__description=_text, dc__identifier=T.ArrayType(_text), dcterms__license=_text, dc__rights=_text, checksum=_text)
RECORD = _struct(status=_text, dc__creator=_text, dcterms__created=_text, dcterms__modified=_text, dc__description=_text)
DETAILS = _struct(dc__description=_text, dcterms__available=_text, dc__creator=_text, dcterms__publisher=_text, is_supertype_of=T.ArrayType(_text), is_subtype_of=T.ArrayType(_text), content_type=_text, reference=T.ArrayType(REFERENCE), example_file=T.ArrayType(EXAMPLE), record_metadata=RECORD)
#: A `format` element; `ord`, its place in the registry, and `source_ord`, that of its file, are added when it is loaded.
ELEMENT = _struct(
    puid=_text, mime=T.ArrayType(_text), container=_text, name=_text, version=_text, alias=_text, pronom_id=_text, extension=T.ArrayType(_text), apple_uti=_text,
    has_priority_over=T.ArrayType(_text), signature=T.ArrayType(SIGNATURE), details=DETAILS,
)
FORMAT = T.StructType([T.StructField("ord", T.LongType()), T.StructField("source_ord", T.IntegerType()), *ELEMENT.fields])
CONTAINER = _struct(container_type=_text, sig_id=_text, puid=_text, path=_text, regex=_text, ord=T.LongType())
OBJECT = _struct(object_id=_text, filename=_text, size=T.LongType(), bof=T.BinaryType(), eof=T.BinaryType(), parent_id=_text, depth=T.IntegerType(), kind=_text)
CANDIDATE = _struct(ord=T.LongType(), puid=_text, prio=T.ArrayType(_text), sigs=T.ArrayType(_struct(sig_ord=T.IntegerType(), name=_text)))
RESULT_COLUMNS = ["status", "time_ms", "puid", "formatname", "signaturename", "filesize", "filename", "mimetype", "matchtype", "version", "alias", "apple_uti", "group_size", "group_index"]

BUFFER = 128 * 1024
CONTAINER_BUFFER = 512 * 1024
