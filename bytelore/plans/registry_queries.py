"""Queries of sources, sinks, records and versions, with their SQL; what they read is made of the tables that the driver gives."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelore import schema
from bytelore.functions import names, sql
from bytelore.functions.batches import in_small_batches
from bytelore.operators import matching, registry, report
from bytelore.operators.identify import FormatIdentifier, Options
from bytelore.plans import catalog
from bytelore.plans import formats as own
from bytelore.plans.made import write_compound
from bytelore.sources import compound, framed, objects, records, registries, single, store, versions
from bytelore.sources.stored import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _in_order(spark: SparkSession, rows: DataFrame, *order) -> DataFrame:
    """Rows in ranges of an order, four for each core: a fixed number of tasks would have more rows each in larger tables."""
    return rows.repartitionByRange(spark.sparkContext.defaultParallelism * 4, *order).sortWithinPartitions(*order)


# ---- files, lists of paths, streams


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a folder for each item of `benchmark`, with its text as a file that ends in a line feed."""
    folder = shared_dir(spark)
    _table(spark, sf_dir, "benchmark").select("item_id", _text("text").alias("value")).write.partitionBy("item_id").text(folder)
    return folder


def _items(found: DataFrame) -> DataFrame:
    item = F.regexp_extract("filename", r"item_id=(\d+)/part-[^/]*\.txt$", 1)
    return found.withColumn("item", item).where("item <> ''").select(F.col("item").cast("long").alias("item_id"), "status", "puid", "matchtype", "filesize")


def files_of_folders(spark, sf_dir):
    roots = spark.createDataFrame([(_written(spark, sf_dir),)], "path string")
    return _items(FormatIdentifier(spark, own.formats(spark), own.containers(spark), Options(archives=True)).files(objects.expanded(roots, recurse=True)))


def files_of_list(spark, sf_dir):
    """As `files_of_folders`, with the folders named in a file."""
    folder, listing = _written(spark, sf_dir), shared_dir(spark)
    _table(spark, sf_dir, "benchmark").select(F.concat(F.lit(f"{folder}/item_id="), F.col("item_id").cast("string"))).write.text(listing)
    return _items(FormatIdentifier(spark, own.formats(spark)).files(objects.expanded(objects.paths_from_list(spark, listing))))


def files_first_level(spark, sf_dir):
    """Roots are folders of files for items of even sevenths, and folders of such folders for the others, of which nothing is listed without the option."""
    folder = shared_dir(spark)
    items = _table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 7).alias("part"), _text("text").alias("value"))
    items.write.partitionBy("part", "item_id").text(folder)
    part = F.concat(F.lit(f"{folder}/part="), F.col("part").cast("string"))
    roots = items.select(F.when(F.col("part") % 2 == 0, F.concat(part, F.lit("/item_id="), F.col("item_id").cast("string"))).otherwise(part).alias("path"))
    item = F.regexp_extract("path", r"item_id=(\d+)/part-[^/]*\.txt$", 1)
    return objects.expanded(roots).select(item.alias("item")).where("item <> ''").select(F.col("item").cast("long").alias("item_id"))


def files_levels(spark, sf_dir):
    """Files three levels down, listed a level at a time; those on the way are listed, too."""
    folder = shared_dir(spark)
    part = _table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), F.col("p_partkey").alias("key"), _text("p_name").alias("value"))
    part.withColumn("a", F.col("size") % 5).drop("key").write.partitionBy("a", "size").text(folder)
    part.where("key % 3 = 0").withColumn("b", F.col("key") % 4).drop("key", "size").write.partitionBy("b").text(f"{folder}/second")
    paths = objects.expanded(spark.createDataFrame([(folder,), ("/no/such/path",)], "path string"), recurse=True)
    kept = paths.where(F.col("path").rlike(r"/part-[^/]*\.txt$"))
    found = objects.objects_of_files(kept, 16).withColumn("folder", F.regexp_extract("filename", r"/(second/b=\d+|a=\d+/size=\d+)/part-", 1))
    return found.groupBy("folder").agg(F.sum("size").alias("bytes"))


def files_windows(spark, sf_dir):
    """Windows read by seeking, for files named by URIs that are opened one by one."""
    paths = objects.expanded(spark.createDataFrame([(_written(spark, sf_dir),)], "path string"), True).where(F.col("path").rlike(r"/part-[^/]*\.txt$"))
    made = objects.objects_of_files(paths, 16).withColumn("item_id", F.regexp_extract("filename", r"item_id=(\d+)", 1).cast("long"))
    return made.select("item_id", "size", F.md5("bof").alias("bof_md5"), F.md5("eof").alias("eof_md5"))


def files_by_reader(spark, sf_dir):
    made = objects.content_of_files(spark, _written(spark, sf_dir), recurse=True).withColumn("item_id", F.regexp_extract("filename", r"item_id=(\d+)/", 1))
    return made.where("item_id <> ''").select(F.col("item_id").cast("long").alias("item_id"), "size", F.md5("content").alias("md5"))


_LICENSED = "regexp_matches(hex(encode(coalesce(text, ''))), '^(..)*416C6C207269676874732072657365727665642E')"
_FILES = f"""SELECT item_id, 'OK' AS status, CASE WHEN {_LICENSED} THEN 'own/20' ELSE 'own/9' END AS puid, CASE WHEN {_LICENSED} THEN 'signature' ELSE 'extension' END AS matchtype, strlen(coalesce(text, ''))::BIGINT + 1 AS filesize FROM benchmark"""


def stream_object(spark, sf_dir):
    """All documents as one stream of bytes, of which two windows are held; its name only gives the extension."""
    with store.opened(_framed(spark, sf_dir)) as f:
        made = objects.object_of_stream(spark, f, "names.pdf", 32)
    found = FormatIdentifier(spark, own.formats(spark)).objects(made, stream=True, extension_of="extension_of").select("object_id", "puid", "matchtype")
    return made.select("object_id", "size", F.md5("bof").alias("bof_md5"), F.md5("eof").alias("eof_md5")).join(found, "object_id")


def _framed(spark: SparkSession, sf_dir: str, where: str = "true") -> str:
    """A file with the documents in the order of their ids, each behind its length; each ends in a line feed."""
    path = f"{shared_dir(spark)}/frames"
    text = _text("text")
    value = F.concat(F.lit("kind: x\nContent-Length: "), (F.octet_length(text) + 1).cast("string"), F.lit("\n\n"), text)
    rows = _table(spark, sf_dir, "documents").where(where).repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id")
    single.write_text(rows.select(value.alias("value")), path)
    return path


def framed_objects(spark, sf_dir):
    """Objects of one framed stream, by ranges of it."""
    return framed.read_frames(spark, _framed(spark, sf_dir), 64, 100).select("filename", "size", F.md5("bof").alias("bof_md5"), F.md5("eof").alias("eof_md5"))


def framed_stream(spark, sf_dir):
    """The same as a stream that is stopped after a third of the file, and goes on from its checkpoint when the rest is there."""
    third = _table(spark, sf_dir, "documents").agg(F.expr("percentile_approx(doc_id, 0.33)")).first()[0]
    out, path = shared_dir(spark), _framed(spark, sf_dir, f"doc_id <= {third}")
    for whole in (False, True):
        if whole:
            store.moved(_framed(spark, sf_dir), path)
        made = framed.stream_frames(spark, path, 64, 100)
        made.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("filename", "size", F.md5("bof").alias("md5"))


# ---- SQL functions


def sql_matches(spark, sf_dir):
    """Sequences compiled and tested by SQL."""
    sql.register(spark)
    catalog.objects_of(spark, sf_dir).createOrReplaceTempView("objects_to_test")
    tested = ", ".join(f"named_struct('sequence', '{s}', 'position', '{p}')" for s, p in (("255044462D", "BOF"), ("2E{1-9}20{1-9}2E", "VAR"), ("FFD9", "EOF"), ("4Z", "BOF")))
    return spark.sql(f"""SELECT object_id, sequence, compile_sequence(sequence, position) AS regex, matches(content, sequence, position) AS held
        FROM objects_to_test LATERAL VIEW inline(array({tested})) AS sequence, position WHERE coalesce(matches(content, sequence, position), true)""")


def sql_members(spark, sf_dir):
    """Members of archives by a table function."""
    sql.register(spark)
    catalog.archives_of(spark, sf_dir, "zip").createOrReplaceTempView("archives_to_open")
    return spark.sql("SELECT object_id, m.name, m.size, md5(m.head) AS head_md5 FROM archives_to_open, LATERAL archive_members(filename, content) AS m WHERE m.name NOT LIKE '%.zip!in.zip'")


# ---- registries in XML


def _part_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry with a format for each part; expressions of odd ones end in a blank."""
    regex = F.concat(F.lit("(?s)\\A"), _text("p_name"), F.when(F.col("p_partkey") % 2 == 1, " ").otherwise(""))
    pattern = F.struct(F.lit("BOF").alias("position"), F.lit("").alias("pronom_pattern"), regex.alias("regex"))
    signature = F.struct(F.col("p_name").alias("name"), F.array().cast("array<string>").alias("note"), F.array(pattern).alias("pattern"))
    made = {
        "ord": F.col("p_partkey").cast("int"), "source_ord": F.lit(0), "puid": F.concat(F.lit("p/"), F.col("p_partkey").cast("string")), "mime": F.array("p_type"), "name": F.col("p_name"), "pronom_id": F.col("p_partkey").cast("string"),
        "extension": F.array(F.lit("x"), F.col("p_size").cast("string")), "has_priority_over": F.array((F.col("p_partkey") + 1).cast("string"), (F.col("p_partkey") * 7).cast("string")), "signature": F.array(signature),
    }
    return _table(spark, sf_dir, "part").select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.FORMAT.fields])


def registry_xml(spark, sf_dir):
    """A registry written as XML and read again."""
    folder = shared_dir(spark)
    registries.write_formats(_part_formats(spark, sf_dir), folder)
    back = registries.read_formats(spark, folder)
    return back.select("puid", "name", F.get("mime", F.lit(0)).alias("mime"), F.concat_ws(",", "extension").alias("extensions"), F.get("signature", F.lit(0))["pattern"][0]["regex"].alias("regex"), F.size("signature").alias("n_signatures"))


def registry_files(spark, sf_dir):
    """A registry in several files, in their order."""
    folder = shared_dir(spark)
    key = F.col("p_partkey").cast("string")
    made = _table(spark, sf_dir, "part").select(F.concat(F.lit("p/"), key).alias("puid"), _text("p_name").alias("name"), F.col("p_partkey").alias("at"))
    made.repartitionByRange(6, "at").sortWithinPartitions("at").drop("at").write.option("rootTag", "formats").option("rowTag", "format").xml(folder)
    return registries.read_formats(spark, folder).select("ord", "puid", "name")


def container_xml(spark, sf_dir):
    """Container signatures whose sequence is in the first file, in the second one, or nowhere; ids are mapped twice."""
    folder = shared_dir(spark)
    part = _table(spark, sf_dir, "part")
    sequence = F.struct(F.struct(F.struct(F.struct(F.array(F.struct(F.array(F.struct(F.concat(F.lit("'"), _text("p_name"), F.lit("' 21")).alias("Sequence"))).alias("SubSequence"))).alias("ByteSequence")).alias("InternalSignature")).alias("InternalSignatureCollection")).alias("BinarySignatures"))["BinarySignatures"]
    held = F.struct(F.col("p_type").alias("Path"), sequence.alias("BinarySignatures"))
    bare = F.struct(F.lit("first").alias("Path"), F.lit(None).cast(part.select(sequence.alias("s")).schema["s"].dataType).alias("BinarySignatures"))
    kind = F.col("p_partkey") % 3
    files = F.struct(F.when(kind == 0, F.array(held)).when(kind == 1, F.array(bare, held)).otherwise(F.array(bare)).alias("File"))
    key = F.col("p_partkey").cast("string")
    signatures = part.select(key.alias("_Id"), F.when(F.col("p_size") % 2 == 0, "ZIP").otherwise("OLE2").alias("_ContainerType"), files.alias("Files"))
    mapping = part.select(key.alias("_signatureId"), F.explode(F.array(F.concat(F.lit("p/"), key), F.lit("p/again"))).alias("_Puid"))
    _in_order(spark, signatures, F.col("_Id").cast("long")).write.option("rootTag", "ContainerSignatures").option("rowTag", "ContainerSignature").xml(f"{folder}/signatures")
    mapping.write.option("rootTag", "FileFormatMappings").option("rowTag", "FileFormatMapping").xml(f"{folder}/mappings")
    return registries.read_containers(spark, f"{folder}/*").select("ord", "container_type", "sig_id", "puid", "path", "regex")


def registry_pronom_only(spark, sf_dir):
    """The first file alone, and with a second one: how many formats each puid's name comes from."""
    first, second = own.formats(spark), _part_formats(spark, sf_dir).withColumn("puid", F.concat(F.lit("own/"), F.col("pronom_id")))
    alone = registry.combine(first).select("puid", F.col("name").alias("first_name"))
    return registry.combine(first, second).select("puid", "name").join(alone, "puid", "left")


# ---- records


def _record(*more: Column) -> Column:
    """XML of a record for each part; the key decides the position, and every eleventh sequence can't be compiled."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    ident = lambda outer, kind, value: tag(outer, F.concat(tag("Identifier", value), tag("IdentifierType", F.lit(kind))))
    key = F.col("p_partkey").cast("string")
    position = F.element_at(F.array(*[F.lit(x) for x in (*RECORD_POSITIONS, "somewhere else")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    value = F.when(F.col("p_partkey") % 11 == 0, F.lit("ZZ")).otherwise(F.concat(F.hex(_text("p_name")), F.lit("{2-*}FF")))
    sequence = tag("ByteSequence", F.concat(tag("PositionType", position), tag("Offset", F.lit("0")), tag("MaxOffset", F.lit("")), tag("ByteSequenceValue", value)))
    related = [tag("RelatedFormat", F.concat(tag("RelationshipType", F.lit("Has priority over")), tag("RelatedFormatID", x.cast("string")))) for x in (F.col("p_partkey") + 1, F.col("p_partkey") * 7)]
    example = tag("ReferenceFile", F.concat(tag("ReferenceFileName", F.lit("f")), ident("ReferenceFileIdentifier", "URL", F.concat(F.lit("host/"), key))))
    body = F.concat(
        tag("FormatID", key), tag("FormatName", _text("p_name")), tag("FormatVersion", F.col("p_size").cast("string")), ident("FileFormatIdentifier", "PUID", F.concat(F.lit("p/"), key)), ident("FileFormatIdentifier", "MIME", F.lit("text/x")),
        tag("ExternalSignature", tag("Signature", F.lit("ext"))), *related, tag("InternalSignature", F.concat(tag("SignatureName", F.lit("  s  ")), sequence)), *more, example,
    )
    return F.concat(F.lit(f'<PRONOM-Report xmlns="{records.NAMESPACE[1:-1]}"><report_format_detail>'), tag("FileFormat", body), F.lit("</report_format_detail></PRONOM-Report>"))


RECORD_POSITIONS = list(records.POSITION_TYPES)


def _spread(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all tasks before they are made larger: a table of short rows is a single task's, whatever its number of rows."""
    return rows.repartition(spark.sparkContext.defaultParallelism * 4, key)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, _table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").cast("int").alias("ord"), _record().alias("xml"))


def pronom_compile(spark, sf_dir):
    """Records compiled into formats: names, positions and expressions."""
    made = records.compiled_texts(_records(spark, sf_dir))
    pattern = F.get(F.get("signature", F.lit(0))["pattern"], F.lit(0))
    return made.select("puid", "name", "version", "pronom_id", F.get("mime", F.lit(0)).alias("mime"), F.get("extension", F.lit(0)).alias("extension"), F.size("signature").alias("n_signatures"), F.get("signature", F.lit(0))["name"].alias("signature"), pattern["position"].alias("position"), pattern["regex"].alias("regex"))


def records_several(spark, sf_dir):
    """Records of three signatures: one that can't be compiled drops those before it, and those behind it stay."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    signature = lambda name, value: tag("InternalSignature", F.concat(tag("SignatureName", F.lit(name)), tag("ByteSequence", F.concat(tag("PositionType", F.lit("Variable")), tag("ByteSequenceValue", value)))))
    second = F.when(F.col("p_partkey") % 3 == 0, F.lit("4Z")).otherwise(F.hex(_text("p_name")))
    rows = _spread(spark, _table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").cast("int").alias("ord"), _record(signature("second", second), signature("third", F.lit("4142"))).alias("xml"))
    return records.compiled_texts(rows).select("puid", F.array_join(F.transform("signature", lambda s: s["name"]), ",").alias("signatures"))


def records_zip(spark, sf_dir):
    """Records packed by the tasks into one zip file, and compiled from ranges of it."""
    path = f"{shared_dir(spark)}/records.zip"
    key = F.col("p_partkey").cast("string")
    rows = _in_order(spark, _table(spark, sf_dir, "part"), "p_partkey")
    single.write_zip(rows.select(names.record_file_column(F.concat(F.lit("p/"), key)).alias("name"), F.encode(_record(), "UTF-8").alias("content")), path)
    found = records.compile_records(spark, path)
    return found.select("ord", "puid", "name", F.concat_ws(",", "has_priority_over").alias("inferior"), F.size("signature").alias("n_signatures"))


def zip_sink(spark, sf_dir):
    """One zip file of all documents, written by the tasks and read again by ranges."""
    path = f"{shared_dir(spark)}/documents.zip"
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.encode(_text("text"), "UTF-8").alias("content"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"))
    single.write_zip(_in_order(spark, rows, "doc_id"), path)
    return single.read_zip(spark, path, 100).select("ord", "name", "size", F.md5("content").alias("md5"))


def archive_members_split(spark, sf_dir):
    """Formats of the members of one zip file, which has a member for each object: parts of it are identified by many tasks."""
    path = f"{shared_dir(spark)}/all.zip"
    single.write_zip(catalog.objects_of(spark, sf_dir).select(F.col("filename").alias("name"), "content"), path)
    found = FormatIdentifier(spark, own.formats(spark), own.containers(spark), Options(archives=True, split=True)).files(spark.createDataFrame([(path,)], "path string"))
    inner = found.where("path <> ''").withColumn("member", F.substring_index("filename", "!", -1))
    return inner.select("member", "status", "puid", "signaturename", "filesize", "matchtype", "group_size", F.coalesce("group_index", F.lit(0)).alias("group_index"), F.col("note").isNotNull().alias("noted"))


def compound_streams(spark, sf_dir):
    """Streams of compound files made of documents: a short one, which goes to the mini stream, and long ones, two of them in folders."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw, data = io.BytesIO(), (text or "").encode()
                write_compound(raw, [("Short", data[:100]), ("Folder/Text", data), ("Folder/Inner/Long", data * 3 + b"." * 4096)], 9 if doc_id % 2 else 12)
                out.append(raw.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(out, pa.binary())], names=["object_id", "content"])

    made = _table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "object_id string, content binary")
    return compound.streams_of(made).select("object_id", "path", "size", F.md5("content").alias("md5"))


def records_one(spark, sf_dir):
    """One record alone; its priorities keep their ids."""
    return records.compiled_texts(_records(spark, sf_dir), puid="p/7").select("puid", "name", F.concat_ws(",", "has_priority_over").alias("inferior"))


def records_dropped(spark, sf_dir):
    """Messages about signatures that can't be compiled."""
    return records.messages_of_texts(_records(spark, sf_dir)).select("puid", "message")


def record_examples(spark, sf_dir):
    """Checksums of example files; here a file's content is its address."""
    made = records.compiled_texts(_records(spark, sf_dir), checksum=records.fetched_checksum(lambda url: url.encode()))
    return made.select("puid", F.col("details.example_file")[0]["checksum"].alias("checksum"))


def priority_id_remap(spark, sf_dir):
    """Inferior ids of records, mapped to puids where the id is known."""
    return records.remapped(_part_formats(spark, sf_dir)).select("puid", F.concat_ws(",", "has_priority_over").alias("inferior"))


# ---- reports


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FormatIdentifier(spark, own.formats(spark), None, Options(containers=False)).content(catalog.objects_of(spark, sf_dir)).withColumn("time_ms", F.lit(0))


def report_lines_read(spark, sf_dir):
    """Lines written by the tasks and read again."""
    folder = shared_dir(spark)
    report.write_lines(_results(spark, sf_dir), folder)
    return report.read_lines(spark, folder).select("status", "puid", "formatname", "signaturename", F.col("filesize").cast("long").alias("filesize"), "filename", F.when(F.col("status") == "OK", F.col("mimetype")).alias("mimetype"), "matchtype")


def report_xml(spark, sf_dir):
    """The XML report, read again."""
    folder = shared_dir(spark)
    report.write_xml(_results(spark, sf_dir), folder)
    names = [n for n in report.XML_ORDER if n != "time"]
    back = spark.read.option("rowTag", "file").schema(", ".join(f"{n} string" for n in report.XML_ORDER)).xml(folder)
    return back.select(*[F.when(F.col(n) != "", F.col(n)).alias(n) for n in names])


def report_counted_lines(spark, sf_dir):
    """Lines with the running number of the object."""
    return report.lines(_results(spark, sf_dir), match="%(info.count)d", no_match="%(info.count)d").select("object_id", F.coalesce("group_index", F.lit(0)).alias("group_index"), F.col("line").cast("long").alias("count"))


def report_summary(spark, sf_dir):
    """What a run counts while its lines are written, without a second pass."""
    results, counts = report.observed(_results(spark, sf_dir))
    report.write_lines(results, shared_dir(spark))
    done = counts.get
    return spark.createDataFrame([tuple(done[n] for n in ("objects", "rows", "unmatched", "bytes", "notes"))], "objects long, rows long, unmatched long, bytes long, notes long")


def elapsed_time(spark, sf_dir):
    found = FormatIdentifier(spark, own.formats(spark)).matches(matching.objects(catalog.objects_of(spark, sf_dir), "object_id", "filename", "content", 1024))
    return found.select("object_id", (F.col("time_ms") >= 0).alias("measured"))


# ---- errors


def broken_signature(spark, sf_dir):
    """A format whose second signature is no expression keeps the match of its first, and the error is noted."""
    sigs = [("first", [], [("BOF", "", "(?s)\\A%PDF")]), ("second", [], [("BOF", "", "(?s)\\A(")]), ("third", [], [("BOF", "", "(?s)\\A%")])]
    rows = [(0, 0, "b/1", [], None, "broken", None, None, None, [], None, [], sigs, None), (1, 0, "b/2", [], None, "free", None, None, None, [], None, [], [("none", [], [])], None)]
    found = FormatIdentifier(spark, spark.createDataFrame(rows, schema.FORMAT), None, Options(containers=False)).content(catalog.objects_of(spark, sf_dir))
    return found.where("puid = 'b/1'").select("object_id", "signaturename", "group_size", F.col("note").isNotNull().alias("noted"))


def unknown_position(spark, sf_dir):
    """Signatures without patterns, or with one at an unknown position, hold for every object that is not empty."""
    sigs = [("none", [], []), ("odd", [], [("ELSEWHERE", "", "(?s)\\Anever")])]
    rows = [(0, 0, "u/1", [], None, "unknown", None, None, None, [], None, [], sigs, None)]
    found = FormatIdentifier(spark, spark.createDataFrame(rows, schema.FORMAT), None, Options(containers=False)).content(catalog.objects_of(spark, sf_dir))
    return found.where("status = 'OK'").groupBy("object_id").agg(F.count("*").alias("n"))


def damaged_containers(spark, sf_dir):
    """Objects that begin as containers and are none: the signature's match stays, and the damage is noted."""
    found = FormatIdentifier(spark, own.formats(spark), own.containers(spark), Options(archives=True)).content(catalog.objects_of(spark, sf_dir))
    return found.where("matchtype = 'signature' AND puid IN ('x-fmt/263', 'fmt/111')").select("object_id", "puid", F.col("note").isNotNull().alias("noted"))


# ---- versions and the service


def versions_latest(spark, sf_dir):
    """Versions of each type, by names with and without a letter, the latest, and whether it is newer than a local one; what is no version doesn't count."""
    letter = F.element_at(F.array(*[F.lit(x) for x in ("v", "", "x")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = _table(spark, sf_dir, "part").select(F.col("p_type").alias("site"), F.concat(letter, F.col("p_size").cast("string")).alias("version"))
    found = versions.latest(rows, "site", "version")
    return found.withColumn("newer", F.col("latest") > names.version_column(F.lit("v25")))


def service_formats(spark, sf_dir):
    """Formats that a signature file lists, in its order."""
    path = f"{shared_dir(spark)}/signatures.xml"
    rows = _table(spark, sf_dir, "part").repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey")
    element = F.format_string('<FileFormat ID="%d" Name="x" PUID="n/%d"/>', F.col("p_partkey"), F.col("p_partkey"))
    single.write_text(rows.select(element.alias("value")), path, '<F xmlns="urn:x"><FileFormatCollection>', "</FileFormatCollection></F>")
    return registries.read_listed(spark, path)


def queries() -> dict:
    return {
        f.__name__: in_small_batches(f)
        for f in (
            files_of_folders, files_of_list, files_first_level, files_levels, files_windows, files_by_reader, stream_object, framed_objects, framed_stream, sql_matches, sql_members, registry_xml, registry_files, container_xml, registry_pronom_only, compound_streams, zip_sink, archive_members_split, pronom_compile, records_zip, records_several, records_one, records_dropped, record_examples,
            priority_id_remap, report_lines_read, report_xml, report_counted_lines, report_summary, elapsed_time, broken_signature, unknown_position, damaged_containers, versions_latest, service_formats,
        )
    }


def oracle_sql() -> dict[str, str]:
    full = f"WITH {catalog.identified()}"
    objects_ = f"WITH {catalog.OBJECTS.format(n=schema.BUFFER)}"
    positions = " ".join(f"WHEN p_partkey % 5 = {k} THEN '{p}'" for k, p in enumerate(records.POSITION_TYPES.values())) + " ELSE 'VAR'"
    at = lambda *kinds: f"p_partkey % 5 IN ({', '.join(str(k) for k, p in enumerate(records.POSITION_TYPES.values()) if p in kinds)})"
    before, after = f"CASE WHEN {at('BOF', 'IFB')} THEN '(?s)\\A' ELSE '(?s)' END", f"CASE WHEN {at('EOF')} THEN '\\Z' ELSE '' END"
    good = lambda x: f"CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE {x} END"
    registry_ = catalog.REGISTRY
    frames = "f AS (SELECT doc_id, hex(encode(coalesce(text, ''))) || '0A' AS h FROM documents), p AS (SELECT *, (length(h) // 2)::BIGINT AS size, 8 + 18 + length((length(h) // 2)::VARCHAR) AS head FROM f), g AS (SELECT 'STDIN!(at ' || (sum(head + size) OVER (ORDER BY doc_id) - size)::BIGINT || ' bytes)' AS filename, size, h FROM p)"
    url = "'http://host/' || p_partkey"
    return {
        "files_of_folders": _FILES,
        "files_of_list": _FILES,
        "files_first_level": "SELECT item_id FROM benchmark WHERE (item_id % 7) % 2 = 0",
        "files_levels": "SELECT 'a=' || (p_size % 5) || '/size=' || p_size AS folder, sum(strlen(coalesce(p_name, '')) + 1)::BIGINT AS bytes FROM part GROUP BY ALL UNION ALL SELECT 'second/b=' || (p_partkey % 4), sum(strlen(coalesce(p_name, '')) + 1)::BIGINT FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL",
        "files_windows": "WITH b AS (SELECT item_id, hex(encode(coalesce(text, ''))) || '0A' AS h FROM benchmark) SELECT item_id, (length(h) // 2)::BIGINT AS size, md5(unhex(substr(h, 1, 32))) AS bof_md5, md5(unhex(CASE WHEN length(h) > 32 THEN right(h, 32) ELSE h END)) AS eof_md5 FROM b",
        "files_by_reader": "SELECT item_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, md5(coalesce(text, '') || chr(10)) AS md5 FROM benchmark",
        "stream_object": f"WITH {frames}, s AS (SELECT hex(encode('kind: x' || chr(10) || 'Content-Length: ' || size || chr(10) || chr(10))) || h AS h, doc_id FROM p), t AS (SELECT string_agg(h || '0A', '' ORDER BY doc_id) AS h FROM (SELECT doc_id, left(h, length(h) - 2) AS h FROM s)) SELECT 'STDIN' AS object_id, (length(h) // 2)::BIGINT AS size, md5(unhex(left(h, 64))) AS bof_md5, md5(unhex(right(h, 64))) AS eof_md5, 'own/2' AS puid, 'extension' AS matchtype FROM t",
        "framed_objects": f"WITH {frames} SELECT filename, size, md5(unhex(left(h, 128))) AS bof_md5, md5(unhex(CASE WHEN length(h) > 128 THEN right(h, 128) ELSE h END)) AS eof_md5 FROM g",
        "framed_stream": f"WITH {frames} SELECT filename, size, md5(unhex(left(h, 128))) AS md5 FROM g",
        "sql_matches": f"""{objects_} SELECT object_id, sequence, regex, CASE WHEN sequence <> '4Z' THEN true END AS held FROM objects, (VALUES ('255044462D', '(?s)\\A%PDF-'), ('2E{{1-9}}20{{1-9}}2E', '(?s)\\..{{1,9}} .{{1,9}}\\.'), ('FFD9', '(?s)\\xff\\xd9\\Z'), ('4Z', NULL)) AS s(sequence, regex)
          WHERE CASE sequence WHEN '255044462D' THEN starts_with(bof, '255044462D') WHEN 'FFD9' THEN ends_with(eof, 'FFD9') WHEN '4Z' THEN true ELSE regexp_matches(bof, '^(..)*2E(..){{1,9}}20(..){{1,9}}2E') END""",
        "sql_members": "WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), m AS (SELECT doc_id, '.zip!a.txt' AS tail, h FROM d UNION ALL SELECT doc_id, '.zip!b.dat', '255044462D312E370A' || h FROM d) SELECT doc_id::VARCHAR AS object_id, doc_id || tail AS name, (length(h) // 2)::BIGINT AS size, md5(unhex(left(h, 128))) AS head_md5 FROM m WHERE h <> ''",
        "registry_xml": "SELECT 'p/' || p_partkey AS puid, p_name AS name, p_type AS mime, 'x,' || p_size AS extensions, '(?s)\\A' || p_name || CASE WHEN p_partkey % 2 = 1 THEN ' ' ELSE '' END AS regex, 1 AS n_signatures FROM part",
        "registry_files": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, 'p/' || p_partkey AS puid, p_name AS name FROM part",
        "container_xml": "SELECT CASE WHEN p_size % 2 = 0 THEN 'ZIP' ELSE 'OLE2' END AS container_type, p_partkey::VARCHAR AS sig_id, 'p/' || p_partkey AS puid, CASE WHEN p_partkey % 3 = 1 THEN 'first' ELSE p_type END AS path, '(?s)' || p_name || '\\!' AS regex, row_number() OVER (ORDER BY p_partkey) - 1 AS ord FROM part QUALIFY p_partkey % 3 < 2",
        "registry_pronom_only": f"WITH {registry_}, second AS (SELECT 'own/' || p_partkey AS puid, p_name AS name FROM part) SELECT coalesce(r.puid, s.puid) AS puid, coalesce(s.name, r.formatname) AS name, r.formatname AS first_name FROM registry r FULL JOIN second s ON r.puid = s.puid",
        "pronom_compile": f"SELECT 'p/' || p_partkey AS puid, p_name AS name, p_size::VARCHAR AS version, p_partkey::VARCHAR AS pronom_id, 'text/x' AS mime, 'ext' AS extension, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 1 END AS n_signatures, {good("'s'")} AS signature, {good(f'CASE {positions} END')} AS position, {good(f"{before} || p_name || '.{{2,}}\\xff' || {after}")} AS regex FROM part",
        "records_several": "SELECT 'p/' || p_partkey AS puid, CASE WHEN p_partkey % 3 = 0 THEN 'third' WHEN p_partkey % 11 = 0 THEN 'second,third' ELSE 's,second,third' END AS signatures FROM part",
        "records_zip": f"WITH e AS (SELECT p_partkey AS k, 0 AS place, p_partkey + 1 AS id FROM part UNION ALL SELECT p_partkey, 1, p_partkey * 7 FROM part), i AS (SELECT k, string_agg(CASE WHEN p.p_partkey IS NULL THEN id::VARCHAR ELSE 'p/' || id END, ',' ORDER BY place) AS inferior FROM e LEFT JOIN part p ON p.p_partkey = id GROUP BY k) SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, 'p/' || p_partkey AS puid, p_name AS name, inferior, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 1 END AS n_signatures FROM part JOIN i ON k = p_partkey",
        "zip_sink": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, source || '/' || doc_id AS name, strlen(coalesce(text, ''))::BIGINT AS size, md5(coalesce(text, '')) AS md5 FROM documents",
        "archive_members_split": f"{full} SELECT filename AS member, status, puid, signaturename, filesize, matchtype, group_size, group_index, bool_or(coalesce(puid = 'x-fmt/263', false) AND matchtype = 'signature') OVER (PARTITION BY object_id) AS noted FROM results WHERE filesize > 0",
        "compound_streams": "WITH d AS (SELECT doc_id::VARCHAR AS object_id, hex(encode(coalesce(text, ''))) AS h FROM documents), s AS (SELECT object_id, unnest(['Short', 'Folder/Text', 'Folder/Inner/Long']) AS path, unnest([left(h, 200), h, h || h || h || repeat('2E', 4096)]) AS h FROM d) SELECT object_id, path, (length(h) // 2)::BIGINT AS size, md5(unhex(h)) AS md5 FROM s",
        "records_one": "SELECT 'p/' || p_partkey AS puid, p_name AS name, (p_partkey + 1) || ',' || (p_partkey * 7) AS inferior FROM part WHERE p_partkey = 7",
        "records_dropped": "SELECT 'p/' || p_partkey AS puid, 'incompatible: not a byte at 0 in ''ZZ''' AS message FROM part WHERE p_partkey % 11 = 0",
        "record_examples": f"SELECT 'p/' || p_partkey AS puid, md5({url}) AS checksum FROM part",
        "priority_id_remap": "WITH e AS (SELECT p_partkey AS k, 0 AS place, p_partkey + 1 AS id FROM part UNION ALL SELECT p_partkey, 1, p_partkey * 7 FROM part) SELECT 'p/' || k AS puid, string_agg(CASE WHEN p.p_partkey IS NULL THEN id::VARCHAR ELSE 'p/' || id END, ',' ORDER BY place) AS inferior FROM e LEFT JOIN part p ON p.p_partkey = id GROUP BY k",
        "report_lines_read": f"{full} SELECT status, puid, formatname, signaturename, filesize, filename, CASE WHEN status = 'OK' THEN coalesce(mimetype, 'None') END AS mimetype, matchtype FROM results",
        "report_xml": f"{full} SELECT filename, status, matchtype, puid, mimetype, formatname, signaturename, filesize::VARCHAR AS filesize FROM results",
        "report_counted_lines": f"{full} SELECT object_id, group_index, dense_rank() OVER (ORDER BY object_id) AS count FROM results",
        "report_summary": f"{full} SELECT count(DISTINCT object_id) AS objects, count(puid) AS rows, count(*) FILTER (status = 'KO') AS unmatched, (SELECT sum(size) FROM objects)::BIGINT AS bytes, 0::BIGINT AS notes FROM results",
        "elapsed_time": f"{objects_} SELECT object_id, true AS measured FROM objects",
        "broken_signature": f"{objects_} SELECT object_id, 'first' AS signaturename, 2 AS group_size, true AS noted FROM objects WHERE starts_with(bof, '25504446')",
        "unknown_position": f"{objects_} SELECT object_id, 2::BIGINT AS n FROM objects WHERE size > 0",
        "damaged_containers": f"{objects_} SELECT object_id, CASE WHEN starts_with(bof, '504B0304') THEN 'x-fmt/263' ELSE 'fmt/111' END AS puid, true AS noted FROM objects WHERE starts_with(bof, '504B0304') OR starts_with(bof, 'D0CF11E0A1B11AE1')",
        "versions_latest": "SELECT p_type AS site, count(DISTINCT p_size) AS n_versions, max(p_size)::BIGINT AS latest, max(p_size) > 25 AS newer FROM part WHERE p_partkey % 3 < 2 GROUP BY ALL",
        "service_formats": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, 'n/' || p_partkey AS puid FROM part",
    }
