"""Registry files: formats and container signatures in XML."""

from __future__ import annotations

from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bytelore import schema
from bytelore.functions.containersyntax import compile_container_sequence
from bytelore.operators.registry import combine
from bytelore.sources import single
from bytelore.sources.stored import numbered

_OPTIONS = {"ignoreSurroundingSpaces": "false", "mode": "FAILFAST", "ignoreNamespace": "false"}


def read_formats(spark: SparkSession, path: str, source_ord: int = 0) -> DataFrame:
    """Formats of a registry file in document order; text is not trimmed, as an expression may end in a blank."""
    rows = _elements(spark, path)
    lists = [f.name for f in schema.ELEMENT.fields if isinstance(f.dataType, T.ArrayType)]
    rows = rows.withColumns({n: F.coalesce(n, F.array().cast(schema.ELEMENT[n].dataType)) for n in lists})
    placed = numbered(rows, "ord", *_PLACE)
    return placed.select((F.col("ord") - 1).alias("ord"), F.lit(source_ord).alias("source_ord"), *[F.col(f"`{f.name}`") for f in schema.ELEMENT.fields])


#: What text pieces between end tags can't tell apart from elements: then a file is read by one task.
_UNSPLIT = r"<!--|<!\[CDATA\[|<\?xml[^>]*encoding=.(?!utf-8|UTF-8)|</format\s|<format(\s[^>]*)?/>"


def _elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of a registry file and their places. A file is cut at the end tags, so that many tasks read it; Spark's reader of whole
    elements gives one file to one task, and is left to files with comments, sections of bare text, other ways to write the tags, or no end."""
    pieces = spark.read.option("lineSep", "</format>").text(path).withColumns(_places())
    opens = F.regexp_instr("value", F.lit(r"<format[\s>]"))
    odd, ends = pieces.agg(F.count_if(F.col("value").rlike(_UNSPLIT)), F.count_if((opens == 0) & F.col("value").contains("</formats"))).first()
    if odd or ends < pieces.select("_file").distinct().count():
        return spark.read.option("rowTag", "format").options(**_OPTIONS).schema(schema.ELEMENT).xml(path).withColumns(_places())
    whole = pieces.where(opens > 0).select(F.concat(F.expr(r"substring(value, regexp_instr(value, '<format[\\s>]'))"), F.lit("</format>")).alias("value"), *_PLACE)
    read = whole.select(F.from_xml("value", schema.ELEMENT, {**_OPTIONS, "rowTag": "format"}).alias("e"), *_PLACE)
    return read.select(*[F.col(f"e.`{f.name}`").alias(f.name) for f in schema.ELEMENT.fields], *_PLACE)


#: What puts elements in the order of files and of places in them: a reader may have any number of splits of several files.
_PLACE = ("_file", "_block", "_row")


def _places() -> dict:
    return dict(zip(_PLACE, (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()), strict=True))


def read_registry(spark: SparkSession, *paths: str) -> DataFrame:
    """Formats of several files, later ones replacing earlier ones in place."""
    return combine(*[read_formats(spark, p) for p in paths])


_CONTAINER_SIGNATURE = T.StructType([
    T.StructField("_Id", T.StringType()), T.StructField("_ContainerType", T.StringType()),
    T.StructField("Files", T.StructType([T.StructField("File", T.ArrayType(T.StructType([
        T.StructField("Path", T.StringType()),
        T.StructField("BinarySignatures", T.StructType([T.StructField("InternalSignatureCollection", T.StructType([T.StructField("InternalSignature", T.ArrayType(T.StructType([
            T.StructField("ByteSequence", T.ArrayType(T.StructType([T.StructField("SubSequence", T.ArrayType(T.StructType([T.StructField("Sequence", T.StringType())])))])))])))]))])),
    ])))])),
])
_MAPPING = T.StructType([T.StructField("_signatureId", T.StringType()), T.StructField("_Puid", T.StringType())])


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """Container signatures: the first path and the first sequence of all files of a signature; those without one are left out; the first mapping of an id counts."""
    rows = spark.read.option("rowTag", "ContainerSignature").options(**_OPTIONS).schema(_CONTAINER_SIGNATURE).xml(path)
    rows = numbered(rows.withColumns(_places()), "ord", *_PLACE).withColumn("ord", F.col("ord") - 1)
    maps = spark.read.option("rowTag", "FileFormatMapping").options(**_OPTIONS).schema(_MAPPING).xml(path).withColumns(_places())
    earliest = Window.partitionBy("_signatureId").orderBy(*_PLACE)
    maps = maps.withColumn("_n", F.row_number().over(earliest)).where("_n = 1").select(F.col("_signatureId").alias("sig_id"), F.col("_Puid").alias("puid"))
    compile_udf = F.udf(compile_container_sequence)  # row by row, but for a few thousand rows once, when a registry is loaded
    inner = lambda column, field: F.filter(F.flatten(F.filter(F.transform(column, lambda x: x[field]), lambda x: x.isNotNull())), lambda x: x.isNotNull())
    signatures = F.flatten(F.filter(F.transform("Files.File", lambda f: f["BinarySignatures"]["InternalSignatureCollection"]["InternalSignature"]), lambda x: x.isNotNull()))
    sequences = F.transform(inner(inner(signatures, "ByteSequence"), "SubSequence"), lambda x: x["Sequence"])
    first = lambda column: F.get(F.filter(column, lambda x: x.isNotNull()), F.lit(0))
    paths = F.transform("Files.File", lambda f: f["Path"])
    found = rows.select(F.col("_ContainerType").alias("container_type"), F.col("_Id").alias("sig_id"), first(paths).alias("path"), first(sequences).alias("sequence"), "ord").where("sequence IS NOT NULL")
    return found.join(maps, "sig_id").select("container_type", "sig_id", "puid", "path", compile_udf("sequence").alias("regex"), "ord")


def read_listed(spark: SparkSession, path: str) -> DataFrame:
    """(ord, puid): the formats that a signature file lists, in its order; those without a puid are left out."""
    rows = spark.read.option("rowTag", "FileFormat").options(**_OPTIONS).schema("_PUID string").xml(path).withColumns(_places()).where("_PUID <> ''")
    return numbered(rows, "ord", *_PLACE).select((F.col("ord") - 1).alias("ord"), F.col("_PUID").alias("puid"))


#: Namespaces of the names with a prefix.
NAMESPACES = 'xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/"'


def _element(name: str, value, kind: T.DataType) -> str:
    """A value as XML; lists repeat their element, and what is missing has none."""
    if value is None:
        return ""
    if isinstance(kind, T.ArrayType):
        return "".join(_element(name, x, kind.elementType) for x in value)
    if isinstance(kind, T.StructType):
        return f"<{name}>{''.join(_element(f.name, value[f.name], f.dataType) for f in kind.fields)}</{name}>"
    return f"<{name}>{escape(str(value))}</{name}>"


def write_formats(formats: DataFrame, path: str, version: str = "0.3") -> None:
    """A registry as one XML file in registry order; tasks make the elements, as Spark's own writer takes no names with a prefix, and write parts of the file."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_element("format", r, schema.ELEMENT) for r in batch.to_pylist()], pa.string())], names=["value"])

    ordered = formats.select(F.col("ord").cast("long").alias("ord"), *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.ELEMENT.fields])
    made = ordered.repartitionByRange("ord").sortWithinPartitions("ord").mapInArrow(run, "value string")
    single.write_text(made, path, f'<?xml version="1.0" encoding="UTF-8"?>\n<formats version="{version}" {NAMESPACES}>', "</formats>")
