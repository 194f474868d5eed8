"""Every query of the format engine by name, with its SQL.

Objects are made of the tables that the driver gives: bytes of magic prefixes and trailers around the texts of documents,
and pages as HTML files. The SQL works on hex text with predicates written by hand for each signature, independently of the
compiler of byte sequences.
"""

from __future__ import annotations

import io
import tarfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelore import schema
from bytelore.functions import names, templates
from bytelore.functions.batches import in_small_batches
from bytelore.functions.bytesyntax import compile_sequence
from bytelore.operators import matching, registry, report
from bytelore.operators.identify import FormatIdentifier, Options
from bytelore.plans import formats as own

PREFIXES = ["", "255044462D312E340A", "89504E470D0A1A0A", "504B0304", "FFD8FFE0", "474946383961", "7B5C72746631", "D0CF11E0A1B11AE1", "6766", "1F8B08", "4D07F041455E", "0000494642580A", "5249464600000000574156450A", "3C21646F63747970652048746D6C3E"]
TRAILERS = ["", "0A2525454F46", "FFD9", "3C2F68746D6C3E0A"]
ENDINGS = [".txt", ".PDF", ".png", ".html", ".gif", "", ".tar.gz", ".lic", ".csv", "."]
WINDOW = 1024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def objects_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object_id, filename, content): documents in many formats; every 97th object is empty."""
    d = _table(spark, sf_dir, "documents")
    content = F.concat(F.unhex(_pick(PREFIXES, F.col("doc_id"))), F.encode("text", "UTF-8"), F.unhex(_pick(TRAILERS, F.col("doc_id"))))
    content = F.when(F.col("doc_id") % 97 == 5, F.lit(b"")).otherwise(content)
    return d.select(F.col("doc_id").cast("string").alias("object_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), _pick(ENDINGS, F.col("doc_id"))).alias("filename"), content.alias("content"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The same objects in SQL, with windows as hex text.
OBJECTS = f"""
made AS (SELECT doc_id, doc_id::VARCHAR AS object_id, source || '/' || doc_id || {_list(ENDINGS)}[(doc_id % {len(ENDINGS)} + 1)::INT] AS filename,
  CASE WHEN doc_id % 97 = 5 THEN '' ELSE {_list(PREFIXES)}[(doc_id % {len(PREFIXES)} + 1)::INT] || hex(encode(text)) || {_list(TRAILERS)}[(doc_id % {len(TRAILERS)} + 1)::INT] END AS h FROM documents),
objects AS (SELECT object_id, doc_id, filename, (length(h) // 2)::BIGINT AS size, substr(h, 1, 2 * {{n}}) AS bof, CASE WHEN length(h) > 2 * {{n}} THEN substr(h, length(h) - 2 * {{n}} + 1) ELSE h END AS eof FROM made)"""

_DOCTYPE = "^3C21(44|64)(4F|6F)(43|63)(54|74)(59|79)(50|70)(45|65)20(48|68)(54|74)(4D|6D)(4C|6C)"
#: Hand-written predicates: (puid, signature number, name) -> SQL over hex windows.
PREDICATES = {
    ("x-fmt/263", 0): "starts_with(bof, '504B0304')",
    ("x-fmt/265", 0): "substr(bof, 515, 10) = '7573746172'",
    ("fmt/111", 0): "starts_with(bof, 'D0CF11E0A1B11AE1')",
    ("own/1", 0): "regexp_matches(substr(bof, 1, 2 * 1029), '^(..)*255044462D')",
    ("own/2", 0): "starts_with(bof, '255044462D312E34') AND regexp_matches(substr(eof, greatest(1, length(eof) - 2 * 1029 + 1)), '^(..)*2525454F46')",
    ("own/3", 0): "starts_with(bof, '89504E470D0A1A0A')",
    ("own/4", 0): "regexp_matches(bof, '^FFD8FFE.') AND ends_with(eof, 'FFD9')",
    ("own/5", 0): "starts_with(bof, '474946383761')",
    ("own/6", 0): "starts_with(bof, '474946383961')",
    ("own/6", 1): "starts_with(bof, '474946383761') OR starts_with(bof, '474946383961')",
    ("own/7", 0): "starts_with(bof, '7B5C727466')",
    ("own/8", 0): "starts_with(bof, '7B5C72746631')",
    ("own/10", 0): f"regexp_matches(bof, '{_DOCTYPE}')",
    ("own/11", 0): f"regexp_matches(bof, '{_DOCTYPE}') AND regexp_matches(substr(eof, greatest(1, length(eof) - 2 * 23 + 1)), '^(..)*3C2F(48|68)(54|74)(4D|6D)(4C|6C)3E')",
    ("own/12", 0): "starts_with(bof, '3C3F786D6C2076657273696F6E3D')",
    ("own/13", 0): "starts_with(bof, '1F8B08')",
    ("own/14", 0): "regexp_matches(bof, '^52494646(..){{4}}57415645')",
    ("own/15", 0): "starts_with(bof, '49492A00')",
    ("own/15", 1): "starts_with(bof, '4D4D002A')",
    ("own/17", 0): "starts_with(bof, '6766')",
    ("own/18", 0): "starts_with(bof, '6766')",
    ("own/19", 0): "starts_with(bof, '6766')",
    ("own/20", 0): "regexp_matches(bof, '^(..)*416C6C207269676874732072657365727665642E')",
    ("own/21", 0): "regexp_matches(bof, '^4D.[7F][1-9A-F].((0[1-9A-F]|[1-9A-F].)(..)*)?455E')",
    ("own/22", 0): "substr(bof, 5, 8) = '49464258'",
}
_BY_PUID = {f[0]: (k, f) for k, f in enumerate(own.FORMATS)}
_TEXT = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
REGISTRY = "registry(ord, puid, formatname, mimetype, version, container) AS (VALUES " + ", ".join(f"({k}, {_TEXT(f[0])}, {_TEXT(f[1])}, {_TEXT(f[3])}, {_TEXT(f[2])}, {_TEXT(f[4])})" for k, f in enumerate(own.FORMATS)) + ")"
_OVER = "over_(puid, inferior) AS (VALUES " + ", ".join(f"({_TEXT(f[0])}, {_TEXT(p)})" for f in own.FORMATS for p in f[6]) + ")"
_EXTENSIONS = "extensions(ord, puid, ext) AS (VALUES " + ", ".join(f"({k}, {_TEXT(f[0])}, {_TEXT(e)})" for k, f in enumerate(own.FORMATS) for e in f[5]) + ")"
_EXT = "ltrim(lower(regexp_extract(filename, '[^/.]\\.*(\\.[^/.]*)$', 1)), '.')"


def _matched(keep=lambda puid: True) -> str:
    parts = [f"SELECT object_id, filename, size, {_BY_PUID[p][0]} AS ord, {k} AS sig_ord, '{p}' AS puid, {_TEXT(_BY_PUID[p][1][7][k][0])} AS signaturename FROM objects WHERE {sql.format()}" for (p, k), sql in PREDICATES.items() if keep(p)]
    return f"""hits AS ({' UNION ALL '.join(parts)}),
formats_hit AS (SELECT DISTINCT object_id, ord, puid FROM hits),
accepted AS (SELECT * FROM formats_hit x WHERE NOT EXISTS (SELECT 1 FROM formats_hit y JOIN over_ o ON o.puid = y.puid WHERE y.object_id = x.object_id AND y.ord < x.ord AND o.inferior = x.puid
  AND NOT EXISTS (SELECT 1 FROM formats_hit z JOIN over_ q ON q.puid = z.puid WHERE z.object_id = y.object_id AND z.ord < y.ord AND q.inferior = y.puid))),
kept AS (SELECT * FROM accepted x WHERE NOT EXISTS (SELECT 1 FROM accepted y JOIN over_ o ON o.puid = y.puid WHERE y.object_id = x.object_id AND o.inferior = x.puid)),
signed AS (SELECT hits.* FROM hits JOIN kept USING (object_id, ord) WHERE size > 0)"""


def identified(n: int = schema.BUFFER, keep=lambda puid: True, extension: bool = True, objects: str = OBJECTS) -> str:
    ext = f"""external AS (SELECT o.object_id, o.filename, o.size, e.ord, 0 AS sig_ord, e.puid, 'External' AS signaturename FROM objects o JOIN extensions e ON e.ext = {_EXT} AND e.ext <> ''
  WHERE o.object_id NOT IN (SELECT object_id FROM signed) AND ({' OR '.join(f"e.puid = '{p}'" for p in _BY_PUID if keep(p)) or 'false'})),
external_kept AS (SELECT * FROM external x WHERE NOT EXISTS (SELECT 1 FROM external y JOIN over_ o ON o.puid = y.puid WHERE y.object_id = x.object_id AND o.inferior = x.puid)),
chosen AS (SELECT *, 'signature' AS matchtype FROM signed UNION ALL SELECT *, 'extension' FROM external_kept)"""
    if not extension:
        ext = "chosen AS (SELECT *, 'signature' AS matchtype FROM signed)"
    join = "LEFT JOIN" if extension else "JOIN"
    return f"""{objects.format(n=n)}, {REGISTRY}, {_OVER}, {_EXTENSIONS}, {_matched(keep)}, {ext},
results AS (SELECT o.object_id, CASE WHEN c.puid IS NULL THEN 'KO' ELSE 'OK' END AS status, c.puid, r.formatname, c.signaturename, o.size AS filesize, o.filename, r.mimetype, coalesce(c.matchtype, 'fail') AS matchtype, r.version, r.container,
  count(c.puid) OVER (PARTITION BY o.object_id)::INT AS group_size, CASE WHEN c.puid IS NOT NULL THEN row_number() OVER (PARTITION BY o.object_id ORDER BY c.ord, c.sig_ord) ELSE 0 END::INT AS group_index, c.ord
  FROM objects o {join} chosen c USING (object_id) LEFT JOIN registry r ON r.puid = c.puid)"""


RESULT = ["object_id", "status", "puid", "formatname", "signaturename", "filesize", "filename", "mimetype", "matchtype", "version", "group_size", "group_index"]
_SELECT = "SELECT " + ", ".join(RESULT) + " FROM results"


def _identifier(spark: SparkSession, formats: DataFrame | None = None, **options) -> FormatIdentifier:
    return FormatIdentifier(spark, own.formats(spark) if formats is None else formats, None, Options(containers=False, **options))


def _results(spark: SparkSession, sf_dir: str, formats: DataFrame | None = None, **options) -> DataFrame:
    return _indexed(_identifier(spark, formats, **options).content(objects_of(spark, sf_dir)))


def _indexed(results: DataFrame) -> DataFrame:
    """Rows without a match have index 0 here, which compares alike everywhere."""
    return results.withColumn("group_index", F.coalesce("group_index", F.lit(0)))


def identify_pages(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("object_id"), F.col("url").alias("filename"), F.encode("html", "UTF-8").alias("content"))
    return _indexed(_identifier(spark).content(pages)).select(*RESULT)


_PAGES = """
made AS (SELECT page_id::VARCHAR AS object_id, url AS filename, hex(encode(html)) AS h FROM pages),
objects AS (SELECT object_id, filename, (length(h) // 2)::BIGINT AS size, substr(h, 1, 2 * {n}) AS bof, CASE WHEN length(h) > 2 * {n} THEN substr(h, length(h) - 2 * {n} + 1) ELSE h END AS eof FROM made)"""


def identify_full(spark, sf_dir):
    return _results(spark, sf_dir).select(*RESULT)


def identify_small_window(spark, sf_dir):
    return _results(spark, sf_dir, bufsize=WINDOW).select(*RESULT)


def identify_no_extension(spark, sf_dir):
    return _results(spark, sf_dir, extension=False).select(*RESULT)


def identify_native(spark, sf_dir):
    """Signatures by built-in expressions only, resolved by the same fold."""
    made = matching.objects(objects_of(spark, sf_dir), "object_id", "filename", "content")
    found = matching.native_candidates(made, registry.compiled(own.formats(spark))).withColumn("m", F.explode(matching.resolved()))
    return found.where("size > 0").select("object_id", F.col("m.puid").alias("puid"), F.size("m.sigs").alias("n_signatures"))


def identify_signature(spark, sf_dir):
    made = matching.objects(objects_of(spark, sf_dir), "object_id", "filename", "content")
    found = _identifier(spark).matches(made).withColumn("m", F.explode("matches"))
    return found.where("size > 0").select("object_id", F.col("m.puid").alias("puid"), F.size("m.sigs").alias("n_signatures"))


_SIGNED = f"SELECT object_id, puid, count(*)::INT AS n_signatures FROM signed GROUP BY ALL"


def objects_windows(spark, sf_dir):
    made = matching.objects(objects_of(spark, sf_dir), "object_id", "filename", "content", WINDOW)
    return made.select("object_id", "size", F.md5("bof").alias("bof_md5"), F.md5("eof").alias("eof_md5"))


def object_md5(spark, sf_dir):
    return objects_of(spark, sf_dir).select("object_id", F.md5("content").alias("md5"))


def _pattern(position: str, sequence: str, offset: str = "0", most: str = "0", size: int = schema.BUFFER):
    def query(spark, sf_dir):
        rows = [(0, 0, "p", [], None, "p", None, None, None, [], None, [], [("s", [], [(position, sequence, compile_sequence(sequence, position, offset, most))])], None)]
        made = matching.objects(objects_of(spark, sf_dir), "object_id", "filename", "content", size)
        found = matching.with_candidates(made, registry.compiled(spark.createDataFrame(rows, schema.FORMAT)))
        return found.where(F.size("candidates") > 0).select("object_id", "size")

    return query


def _pattern_sql(predicate: str, size: int = schema.BUFFER) -> str:
    return f"WITH {OBJECTS.format(n=size)} SELECT object_id, size FROM objects WHERE {predicate}"


_MASKS = "|".join(f"{b:02X}" for b in range(256) if b & 0x07 == 0x07)
PATTERNS = {
    "bof_match": (("BOF", "255044462D"), "starts_with(bof, '255044462D')"),
    "bof_offset_match": (("BOF", "494642", "2"), "substr(bof, 5, 6) = '494642'"),
    "bof_max_offset_match": (("BOF", "6E64", "3", "40"), "regexp_matches(bof, '^(..){3,40}6E64')"),
    "eof_match": (("EOF", "FFD9"), "ends_with(eof, 'FFD9')"),
    "eof_offset_match": (("EOF", "2525", "4"), "substr(eof, greatest(1, length(eof) - 11), 4) = '2525' AND length(eof) >= 12"),
    "var_match": (("VAR", "6E6F6E"), "regexp_matches(bof, '^(..)*6E6F6E')"),
    "ifb_match": (("IFB", "49464258", "2"), "substr(bof, 5, 8) = '49464258'"),
    "bitmask_all_match": (("BOF", "4D&07"), f"regexp_matches(bof, '^4D({_MASKS})')"),
    "bitmask_any_match": (("BOF", "~80"), "regexp_matches(bof, '^[89A-F].')"),
    "bitmask_any_zero_match": (("BOF", "~00"), "true"),
    "exclusion_match": (("BOF", "[!25]"), "NOT starts_with(bof, '25')"),
    "range_match": (("BOF", "[41:5A]{1}[61:7A]"), "regexp_matches(bof, '^(4[1-9A-F]|5[0-9A])..(6[1-9A-F]|7[0-9A])')"),
    "gap_match": (("BOF", "52494646{4}57415645"), "regexp_matches(bof, '^52494646(..){4}57415645')"),
    "gap_range_match": (("VAR", "74{1-3}68"), "regexp_matches(bof, '^(..)*74(..){1,3}68')"),
    "gap_open_match": (("BOF", "25{8-*}2E"), "regexp_matches(bof, '^25(..){8}(..)*2E')"),
    "gap_chain_match": (("VAR", "74{1-40}68{2-60}65{1-40}2E{1-*}2E"), "regexp_matches(bof, '^(..)*74(..){1,40}68(..){2,60}65(..){1,40}2E..(..)*2E')"),
    "gap_chain_end_match": (("EOF", "2E{2-30}2E", "1", "40"), "regexp_matches(eof, '^(..)*2E(..){2,30}2E(..){1,40}$')"),
    "wildcard_match": (("BOF", "47*61+2E"), "regexp_matches(bof, '^47(..)*61(..)(..)*2E')"),
    "optional_match": (("VAR", "61??62"), "regexp_matches(bof, '^(..)*61(..)?62')"),
    "alternative_match": (("BOF", "(25|47|[80:8F])"), "regexp_matches(bof, '^(25|47|8.)')"),
}


def signature_conjunction(spark, sf_dir):
    return identify_full(spark, sf_dir).where("puid IN ('own/2', 'own/4')").select("object_id", "puid")


def signature_multi(spark, sf_dir):
    return identify_full(spark, sf_dir).where("puid = 'own/6' AND matchtype = 'signature'").select("object_id", "signaturename", "group_size", "group_index")


def priority_nontransitive(spark, sf_dir):
    return identify_signature(spark, sf_dir).where("puid IN ('own/17', 'own/18', 'own/19')").select("object_id", "puid")


def extension_match(spark, sf_dir):
    made = objects_of(spark, sf_dir).select("object_id", "filename", names.extension_column("filename").alias("ext"))
    return made.join(registry.small(registry.extension_table(own.formats(spark))), "ext").where("ext <> ''").select("object_id", "ext", "puid")


def extension_names(spark, sf_dir):
    return objects_of(spark, sf_dir).select("object_id", names.extension_column("filename").alias("ext"), names.extension_column(names.member_name("filename", F.lit("inner/readme"))).alias("member_ext"))


KEPT = ["own/1", "own/6", "own/9", "x-fmt/263"]


def use_formats(spark, sf_dir):
    return _results(spark, sf_dir, registry.include(own.formats(spark), KEPT)).select(*RESULT)


def nouse_formats(spark, sf_dir):
    return _results(spark, sf_dir, registry.exclude(own.formats(spark), KEPT)).select(*RESULT)


def registry_override(spark, sf_dir):
    """Two files; the second replaces two formats in their earlier places and adds one."""
    first = own.formats(spark)
    part = _table(spark, sf_dir, "part").select(F.concat(F.lit("own/"), F.col("p_partkey").cast("string")).alias("puid"), F.col("p_name").alias("name"), F.col("p_partkey").cast("int").alias("ord"))
    blank = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in schema.FORMAT.fields}
    second = part.select(*[part[c].alias(c) if c in part.columns else blank[c] for c in schema.FORMAT.names])
    return registry.combine(first, second).select("puid", "name", F.col("ord").cast("long").alias("ord"))


def match_groups(spark, sf_dir):
    return identify_full(spark, sf_dir).where("status = 'OK'").groupBy("object_id").agg(F.max("group_size").alias("group_size"), F.max("group_index").alias("last_index"), F.count("*").alias("n"))


def report_csv_lines(spark, sf_dir):
    found = _results(spark, sf_dir).withColumn("time_ms", F.lit(0))
    return report.lines(found).where("status = 'OK'").select("object_id", "group_index", F.regexp_replace("line", "\n$", "").alias("line"))


def report_ko_lines(spark, sf_dir):
    found = _results(spark, sf_dir).withColumn("time_ms", F.lit(0))
    return report.lines(found, match="").select("object_id", F.regexp_replace("line", "\n$", "").alias("line"))


def report_custom_lines(spark, sf_dir):
    found = _results(spark, sf_dir).withColumn("time_ms", F.lit(0))
    template = templates.unescaped("%(info.group_index)d/%(info.group_size)d\\t%(info.puid)-12s|%(info.filesize)08d|%(info.version)s 100%%")
    return report.lines(found, match=template, no_match="").select("object_id", "group_index", "line")


def container_types(spark, sf_dir):
    ident = _identifier(spark)
    made = ident.matches(matching.objects(objects_of(spark, sf_dir), "object_id", "filename", "content"))
    return made.select("object_id", matching.container_type("matches", ident.registry.formats).alias("container")).where("container IS NOT NULL")


def priority_edges(spark, sf_dir):
    """Pairs of formats of which the first has priority, each once; here a format for each part."""
    key = F.col("p_partkey")
    over = F.array(*[x.cast("string") for x in (key + 1, key * 7, key + 1)])
    return registry.priority_edges(_table(spark, sf_dir, "part").select(key.cast("string").alias("puid"), over.alias("has_priority_over")))


def format_histogram(spark, sf_dir):
    return report.formats_found(_results(spark, sf_dir))


def matchtype_summary(spark, sf_dir):
    return report.match_types(_results(spark, sf_dir))


def record_files(spark, sf_dir):
    puid = F.concat_ws("/", F.lit("fmt"), F.col("p_partkey").cast("string"))
    return _table(spark, sf_dir, "part").select("p_partkey", names.record_file_column(puid).alias("file"))


def container_sequence_match(spark, sf_dir):
    """Container sequences over whole texts: quoted text, hex pairs, alternatives."""
    from bytelore.functions.containersyntax import compile_container_sequence

    regex = compile_container_sequence("'th' [61-65 'i'] 6E")
    d = _table(spark, sf_dir, "documents")
    return d.where(F.regexp_like("text", F.lit(regex))).select("doc_id")


def archives_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Archives built in tasks: documents as members, one of them an archive itself; tar files also have a folder."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf.doc_id, pdf.text, strict=True):
                data, inner = text.encode(), io.BytesIO()
                with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("deep.txt", data or b"x")
                items = [("a.txt", data), ("empty.bin", b""), ("b.dat", b"%PDF-1.7\n" + data), ("in.zip", inner.getvalue())]
                raw = io.BytesIO()
                if kind == "zip":
                    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                        for n, b in items:
                            z.writestr(n, b)
                else:
                    with tarfile.open(fileobj=raw, mode="w", format=tarfile.USTAR_FORMAT) as t:
                        folder = tarfile.TarInfo("folder")
                        folder.type = tarfile.DIRTYPE
                        t.addfile(folder)
                        for n, b in items:
                            info = tarfile.TarInfo(n)
                            info.size = len(b)
                            t.addfile(info, io.BytesIO(b))
                out.append((str(doc_id), f"{doc_id}.{kind}", raw.getvalue()))
            yield pd.DataFrame(out, columns=["object_id", "filename", "content"])

    return d.mapInPandas(run, "object_id string, filename string, content binary")


def _members(kind: str):
    def query(spark, sf_dir):
        ident = FormatIdentifier(spark, own.formats(spark), own.containers(spark), Options(archives=True))
        return _indexed(ident.content(archives_of(spark, sf_dir, kind))).select("object_id", "filename", "status", "puid", "matchtype", "group_size", "group_index")

    return query


def _members_sql(kind: str) -> str:
    rows = {
        "zip": ["('', 'OK', 'x-fmt/263', 'signature')", "('!a.txt', 'OK', 'own/9', 'extension')", "('!b.dat', 'OK', 'own/1', 'signature')", "('!in.zip', 'OK', 'x-fmt/263', 'signature')", "('!in.zip!deep.txt', 'OK', 'own/9', 'extension')"],
        "tar": ["('', 'OK', 'x-fmt/265', 'signature')", "('!a.txt', 'KO', NULL, 'fail')", "('!empty.bin', 'KO', NULL, 'fail')", "('!b.dat', 'OK', 'own/1', '')", "('!in.zip', 'OK', 'x-fmt/263', '')", "('!in.zip!deep.txt', 'OK', 'own/9', 'extension')"],
    }[kind]
    license_hit = "regexp_matches(substr(hex(encode(text)), 1, {n}), '^(..)*416C6C207269676874732072657365727665642E')"
    # members whose text has the license line are signature matches of that format, beside the others
    return f"""WITH m(tail, status, puid, matchtype) AS (VALUES {', '.join(rows)}),
d AS (SELECT doc_id, text, {license_hit.format(n=262144)} AS lic FROM documents),
x AS (SELECT doc_id, doc_id || '.{kind}' || tail AS filename, tail, m.* EXCLUDE (tail), lic AND tail IN ('!a.txt', '!b.dat', '!in.zip!deep.txt') AS hit, lic, coalesce(text, '') = '' AS no_text FROM d CROSS JOIN m WHERE NOT (coalesce(text, '') = '' AND tail = '!a.txt' AND '{kind}' = 'zip')),
y AS (SELECT doc_id, filename, 'OK' AS status, 'own/20' AS puid, CASE WHEN '{kind}' = 'tar' AND tail IN ('!a.txt', '!b.dat') THEN '' ELSE 'signature' END AS matchtype, 2 AS place FROM x WHERE hit
  UNION ALL SELECT doc_id, filename, status, puid, matchtype, 1 FROM x WHERE NOT (hit AND (status = 'KO' OR puid = 'own/9'))
  UNION ALL SELECT doc_id, filename, 'OK', 'own/20', 'signature', 2 FROM x WHERE tail = '' AND lic AND '{kind}' = 'tar')
SELECT doc_id::VARCHAR AS object_id, filename, status, puid, matchtype, count(puid) OVER (PARTITION BY filename)::INT AS group_size, CASE WHEN puid IS NOT NULL THEN row_number() OVER (PARTITION BY filename ORDER BY place) ELSE 0 END::INT AS group_index FROM y"""


def container_deep_scan(spark, sf_dir):
    """Documents as zip files that hold a registered member for every third one."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf.doc_id, pdf.text, strict=True):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("body.xml", text)
                    if doc_id % 3 == 0:
                        z.writestr("mimetype", "application/vnd.oasis.opendocument.text" if doc_id % 2 else "other")
                    if doc_id % 3 == 1:
                        z.writestr("[Content_Types].xml", "<Types>wordprocessingml</Types>")
                out.append((str(doc_id), f"{doc_id}.bin", raw.getvalue()))
            yield pd.DataFrame(out, columns=["object_id", "filename", "content"])

    ident = FormatIdentifier(spark, own.formats(spark), own.containers(spark), Options())
    return ident.content(d.mapInPandas(run, "object_id string, filename string, content binary")).select("object_id", "puid", "signaturename", "matchtype")


_DEEP = """SELECT doc_id::VARCHAR AS object_id, CASE WHEN doc_id % 3 = 1 THEN 'own/23' WHEN doc_id % 6 = 3 THEN 'own/24' ELSE 'x-fmt/263' END AS puid,
CASE WHEN doc_id % 3 = 1 THEN 'Office Open XML document' WHEN doc_id % 6 = 3 THEN 'OpenDocument text' ELSE 'ZIP local header' END AS signaturename,
CASE WHEN doc_id % 3 = 1 OR doc_id % 6 = 3 THEN 'container' ELSE 'signature' END AS matchtype FROM documents"""


def queries() -> dict:
    found = {
        f.__name__: f
        for f in (
            identify_pages, identify_full, identify_small_window, identify_no_extension, identify_native, identify_signature, objects_windows, object_md5, signature_conjunction, signature_multi, priority_nontransitive,
            extension_match, extension_names, use_formats, nouse_formats, registry_override, match_groups, report_csv_lines, report_ko_lines, report_custom_lines, container_types, priority_edges,
            format_histogram, matchtype_summary, record_files, container_sequence_match, container_deep_scan,
        )
    }
    found |= {name: _pattern(*args) for name, (args, _) in PATTERNS.items()}
    found |= {"zip_members": _members("zip"), "tar_members": _members("tar")}
    return {name: in_small_batches(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    full = f"WITH {identified()}"
    line = "'OK,0,' || puid || ',\"' || formatname || '\",\"' || signaturename || '\",' || filesize || ',\"' || filename || '\",\"' || coalesce(mimetype, 'None') || '\",\"' || matchtype || '\"'"
    found = {
        "identify_pages": f"WITH {identified(objects=_PAGES)} {_SELECT}",
        "identify_full": f"{full} {_SELECT}",
        "identify_small_window": f"WITH {identified(n=WINDOW)} {_SELECT}",
        "identify_no_extension": f"WITH {identified(extension=False)} {_SELECT}",
        "identify_signature": f"{full} {_SIGNED}",
        "identify_native": f"{full} {_SIGNED}",
        "objects_windows": f"WITH {OBJECTS.format(n=WINDOW)} SELECT object_id, size, md5(unhex(bof)) AS bof_md5, md5(unhex(eof)) AS eof_md5 FROM objects",
        "object_md5": f"WITH {OBJECTS.format(n=WINDOW)} SELECT object_id, md5(unhex(h)) AS md5 FROM made",
        "signature_conjunction": f"{full} SELECT object_id, puid FROM results WHERE puid IN ('own/2', 'own/4')",
        "signature_multi": f"{full} SELECT object_id, signaturename, group_size, group_index FROM results WHERE puid = 'own/6' AND matchtype = 'signature'",
        "priority_nontransitive": f"WITH {OBJECTS.format(n=WINDOW)} SELECT object_id, unnest(['own/17', 'own/19']) AS puid FROM objects WHERE starts_with(bof, '6766')",
        "extension_match": f"WITH {OBJECTS.format(n=WINDOW)}, {_EXTENSIONS} SELECT object_id, ext, puid FROM objects JOIN extensions ON ext = {_EXT} AND ext <> ''",
        "extension_names": f"WITH {OBJECTS.format(n=WINDOW)} SELECT object_id, {_EXT} AS ext, ltrim(lower(regexp_extract(filename || '!inner/readme', '[^/.]\\.*(\\.[^/.]*)$', 1)), '.') AS member_ext FROM objects",
        "use_formats": f"WITH {identified(keep=lambda p: p in KEPT)} {_SELECT}",
        "nouse_formats": f"WITH {identified(keep=lambda p: p not in KEPT)} {_SELECT}",
        "registry_override": f"WITH {REGISTRY}, second AS (SELECT 'own/' || p_partkey AS puid, p_name AS name, p_partkey AS ord FROM part) SELECT coalesce(r.puid, s.puid) AS puid, coalesce(s.name, r.formatname) AS name, coalesce(r.ord, 4294967296 + s.ord)::BIGINT AS ord FROM registry r FULL JOIN second s ON r.puid = s.puid",
        "match_groups": f"{full} SELECT object_id, max(group_size) AS group_size, max(group_index) AS last_index, count(*) AS n FROM results WHERE status = 'OK' GROUP BY object_id",
        "report_csv_lines": f"{full} SELECT object_id, group_index, {line} AS line FROM results WHERE status = 'OK'",
        "report_ko_lines": f"{full} SELECT object_id, 'KO,0,,,,' || filesize || ',\"' || filename || '\",,\"fail\"' AS line FROM results WHERE status = 'KO'",
        "report_custom_lines": f"{full} SELECT object_id, group_index, group_index || '/' || group_size || chr(9) || rpad(puid, 12, ' ') || '|' || lpad(filesize::VARCHAR, 8, '0') || '|' || coalesce(version, 'None') || ' 100%' AS line FROM results WHERE status = 'OK'",
        "container_types": f"WITH {OBJECTS.format(n=schema.BUFFER)} SELECT object_id, CASE WHEN starts_with(bof, '504B0304') THEN 'zip' WHEN starts_with(bof, 'D0CF11E0A1B11AE1') THEN 'ole' END AS container FROM objects WHERE starts_with(bof, '504B0304') OR starts_with(bof, 'D0CF11E0A1B11AE1')",
        "priority_edges": "SELECT p_partkey::VARCHAR AS puid, unnest([p_partkey + 1, p_partkey * 7])::VARCHAR AS inferior FROM part",
        "format_histogram": f"{full} SELECT puid, formatname, count(*) AS n FROM results WHERE status = 'OK' GROUP BY ALL",
        "matchtype_summary": f"{full} SELECT status, matchtype, count(*) AS n, count(DISTINCT object_id) AS objects FROM results GROUP BY ALL",
        "record_files": "SELECT p_partkey, 'puid.fmt.' || p_partkey || '.xml' AS file FROM part",
        "container_sequence_match": "SELECT doc_id FROM documents WHERE regexp_matches(text, 'th(a|e|i)n')",
        "container_deep_scan": _DEEP,
        "zip_members": _members_sql("zip"),
        "tar_members": _members_sql("tar"),
    }
    return found | {name: _pattern_sql(sql) for name, (_, sql) in PATTERNS.items()}
