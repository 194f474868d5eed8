"""Reports of result rows: lines by templates, XML, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from bytelore.functions import templates
from bytelore.sources.stored import numbered

#: Columns of default lines, and elements of a file in the XML report, in their orders.
LINE_ORDER = ["status", "time", "puid", "formatname", "signaturename", "filesize", "filename", "mimetype", "matchtype"]
XML_ORDER = ["filename", "status", "matchtype", "time", "puid", "mimetype", "formatname", "signaturename", "filesize"]


def counted(results: DataFrame) -> DataFrame:
    """`count`: the running number of the object or member, from 1, in the order of the output."""
    keys = ["object_id", "path", "filename"]
    n = numbered(results.select(*keys).distinct(), "count", *keys)
    same = [results[k].eqNullSafe(n[k]) for k in keys]
    return results.join(n, same).select(results["*"], "count")


def lines(results: DataFrame, match: str = templates.MATCH, no_match: str = templates.NO_MATCH, keep_all: bool = False) -> DataFrame:
    """`line` of each result; an empty template leaves its rows out, or, with `keep_all`, their lines empty. A template that uses the running number gets it."""
    if "count" not in results.columns and any(slot and slot["name"] == "info.count" for t in (match, no_match) for _, slot in templates.parts(t)):
        results = counted(results)
    ok = F.col("status") == "OK"
    without = {k: templates.FIELDS[k] for k in templates.FIELDS_NO_MATCH if templates.FIELDS[k] in results.columns}
    have = {k: v for k, v in templates.FIELDS.items() if v in results.columns}
    shown = results if keep_all else results.where(F.lit(bool(match)) & ok | F.lit(bool(no_match)) & ~ok)
    text = F.when(ok, templates.line(match, have) if match else F.lit("")).otherwise(templates.line(no_match, without) if no_match else F.lit(""))
    return shown.withColumn("line", text)


def write_lines(results: DataFrame, path: str, match: str = templates.MATCH, no_match: str = templates.NO_MATCH) -> None:
    """Text files of lines; Spark ends each with a line feed, so the template's own is taken off."""
    lines(results, match, no_match).select(F.regexp_replace("line", r"\n\z", "")).write.text(path)


def read_lines(spark, path: str) -> DataFrame:
    """The nine columns of default lines."""
    return spark.read.schema(", ".join(f"{n} string" for n in LINE_ORDER)).csv(path, escape='"')


def xml_rows(rows: DataFrame) -> DataFrame:
    """Columns of the XML report, in its order."""
    return rows.select(*[F.col(n if n != "time" or "time" in rows.columns else "time_ms").alias(n) for n in XML_ORDER])


def write_xml(rows: DataFrame, path: str) -> None:
    xml_rows(rows).write.option("rootTag", "identification_output").option("rowTag", "file").option("nullValue", "").xml(path)


def xml_text(rows: list, program_version: str, signature_version: str, root: str = "identification_output") -> str:
    """A small report as one document, with text escaped."""
    from xml.sax.saxutils import escape

    files = "".join("<file>" + "".join(f"<{n}>{escape('' if r[n] is None else str(r[n]))}</{n}>" for n in XML_ORDER) + "</file>" for r in rows)
    return f'<?xml version="1.0" encoding="utf-8"?>\n<{root}><versions><program_version>{escape(program_version)}</program_version><signature_version>{escape(signature_version)}</signature_version></versions>{files}</{root}>\n'


def formats_found(results: DataFrame) -> DataFrame:
    return results.where("status = 'OK'").groupBy("puid", "formatname").agg(F.count("*").alias("n"))


def match_types(results: DataFrame) -> DataFrame:
    return results.groupBy("status", "matchtype").agg(F.count("*").alias("n"), F.countDistinct("object_id").alias("objects"))


def observed(results: DataFrame) -> tuple[DataFrame, Observation]:
    """The results, and what is counted while they are used: objects (and members), result rows, objects without a match, bytes, objects with notes and one of these.

    Each object has one row that is its first, so nothing has to be told apart, and nothing runs twice.
    """
    found, first = Observation(), F.coalesce("group_index", F.lit(1)) == 1
    none = F.lit(0).cast("long")
    counts = {
        "objects": F.count_if(first), "rows": F.count_if(F.col("status") == "OK"), "unmatched": F.count_if(F.col("status") == "KO"), "bytes": F.coalesce(F.sum(F.when(first, F.col("filesize"))), none),
        "notes": F.count_if(first & F.col("note").isNotNull()), "note": F.min(F.when(first, F.col("note"))),
    }
    return results.observe(found, *[c.alias(n) for n, c in counts.items()]), found


def summary(n: int, seconds: float) -> str:
    return f"Processed {n} files in {seconds * 1000:.2f} msec, {n / seconds if seconds else 9999:.0f} files/sec"
