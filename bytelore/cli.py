"""Command lines: identify files (`main`), compile records (`prepare`), update the registry (`update`), convert lines to XML (`to_xml_main`).

`python -m bytelore.cli` identifies; the others are `python -m bytelore.cli prepare`, `update` and `toxml`.
"""

from __future__ import annotations

import argparse
import csv
import os
import shutil
import sys
import time
from collections.abc import Callable
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession

from bytelore import __version__, schema
from bytelore.functions import templates
from bytelore.operators import registry, report
from bytelore.operators.identify import FormatIdentifier, Options
from bytelore.plans import formats as own
from bytelore.sources import objects, records, registries, service, versions
from bytelore.sources.versions import Versions


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bytelore", description="Identifies the formats of files.", fromfile_prefix_chars="@")
    p.add_argument("-v", action="store_true", help="show the version")
    p.add_argument("-q", action="store_true", help="no banner and summary")
    p.add_argument("-recurse", action="store_true", help="files of subfolders, too")
    p.add_argument("-zip", action="store_true", help="members of zip and tar files, too")
    p.add_argument("-noextension", action="store_true", help="no matches by extension")
    p.add_argument("-nocontainer", action="store_true", help="no deep scan of containers")
    p.add_argument("-pronom_only", action="store_true", help="without the file of additional formats")
    which = p.add_mutually_exclusive_group()
    which.add_argument("-input", help="file with a path on each line; - for standard input")
    which.add_argument("files", nargs="*", default=[], help="files or folders; - for content from standard input")
    p.add_argument("-filename", help="name of content from standard input, for its extension")
    p.add_argument("-multi", action="store_true", help="standard input holds several objects, each after lines with its content-length")
    p.add_argument("-useformats", help="only these puids, separated by commas")
    p.add_argument("-nouseformats", help="all but these puids")
    p.add_argument("-matchprintf", help="template of lines with a match")
    p.add_argument("-nomatchprintf", help="template of lines without one")
    p.add_argument("-bufsize", type=int, default=schema.BUFFER, help="bytes of each window")
    p.add_argument("-container_bufsize", type=int, default=schema.CONTAINER_BUFFER, help="accepted for compatibility")
    p.add_argument("-sigs", help="check, update, list or a version; needs -confdir")
    p.add_argument("-loadformats", help="further registry files, separated by commas")
    p.add_argument("-confdir", help="folder of the registry files")
    p.add_argument("-outdir", help="folder that the tasks write the lines to, in no order, instead of standard output")
    return p


def load(spark: SparkSession, args: argparse.Namespace):
    """Formats and container signatures that the arguments name; the own registry without a folder."""
    if args.confdir:
        v = Versions.read(os.path.join(args.confdir, "versions.xml"))
        files = [v.pronom_signature] + ([] if args.pronom_only else [v.extension_signature])
        formats = registries.read_registry(spark, *[os.path.join(args.confdir, f) for f in files if f])
        containers = registries.read_containers(spark, os.path.join(args.confdir, v.pronom_container_signature)) if v.pronom_container_signature else None
    else:
        formats, containers = own.formats(spark), own.containers(spark)
    if args.loadformats:
        formats = registry.combine(formats, *[registries.read_formats(spark, f) for f in args.loadformats.split(",")])
    if args.useformats:
        formats = registry.include(formats, args.useformats.split(","))
    elif args.nouseformats:
        formats = registry.exclude(formats, args.nouseformats.split(","))
    return formats, containers


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None, fetch: versions.Fetch = service.over_http, stdin=None) -> int:
    argv, out, stdin = sys.argv[1:] if argv is None else argv, out or sys.stdout, stdin or sys.stdin
    if argv and argv[0] in COMMANDS:
        return COMMANDS[argv[0]](argv[1:], out)
    if not argv:
        parser().print_help(out)
        return 1
    args = parser().parse_args(argv)
    if args.v:
        print(f"bytelore {__version__}", file=out)
        return 0
    if args.sigs:
        return signatures(args, fetch, out)
    began = perf_counter()
    spark = spark or SparkSession.builder.getOrCreate()
    formats, containers = load(spark, args)
    options = Options(bufsize=args.bufsize, container_bufsize=args.container_bufsize, extension=not args.noextension, containers=not args.nocontainer, archives=args.zip, split=args.zip)
    identifier = FormatIdentifier(spark, formats, containers, options)
    if args.files == ["-"]:
        if args.zip:
            raise SystemExit("members of archives need files")
        made = objects.objects_of_framed_stream(spark, stdin.buffer, args.bufsize) if args.multi else objects.object_of_stream(spark, stdin.buffer, args.filename, args.bufsize, objects.linked_name())
        results = identifier.objects(made, stream=True, extension_of="extension_of")
    else:
        if args.input and args.input != "-":
            roots = objects.paths_from_list(spark, args.input)
        else:
            roots = spark.createDataFrame([(name.removesuffix("\n"),) for name in (stdin.readlines() if args.input else args.files)], "path string")
        results = identify_files(identifier, roots, args.recurse)
    match = templates.MATCH if args.matchprintf is None else templates.unescaped(args.matchprintf)
    no_match = templates.NO_MATCH if args.nomatchprintf is None else templates.unescaped(args.nomatchprintf)
    if args.outdir:
        results, counts = report.observed(results)
        report.write_lines(results, args.outdir, match, no_match)
        n = counts.get["objects"]
        notes = [f"{counts.get['notes']} objects with errors, such as: {counts.get['note']}"] if counts.get["notes"] else []
    else:
        n, last, notes = 0, None, []
        for row in report.lines(results, match, no_match, keep_all=True).orderBy("object_id", "path", "group_index").toLocalIterator():
            here = row.object_id, row.path, row.filename
            if here != last:
                n, last = n + 1, here
                notes += [row.note] if row.note else []
            out.write(row.line)
    for note in dict.fromkeys(notes):
        print(note, file=sys.stderr)
    if not args.q:
        print(report.summary(n, perf_counter() - began), file=sys.stderr)
    return 0


def identify_files(identifier: FormatIdentifier, roots: DataFrame, recurse: bool = False) -> DataFrame:
    """Results for the files of roots (path); tasks list the folders, open the files and read of each what is looked at."""
    paths = objects.expanded(roots, recurse)
    return identifier.files(paths.repartition(max(1, identifier.spark.sparkContext.defaultParallelism), "path"))


def signatures(args: argparse.Namespace, fetch: versions.Fetch, out) -> int:
    """The action on registry files that -sigs names."""
    if not args.confdir:
        raise SystemExit("-sigs needs -confdir, the folder of the registry files")
    path = os.path.join(args.confdir, "versions.xml")
    local = Versions.read(path)
    if not local.update_site:
        raise SystemExit(f"{path} names no update site")
    try:
        new = versions.act(args.sigs, local, versions.UpdateSite(local.update_site.rstrip("/"), fetch), args.confdir, lambda line: print(line, file=out))
    except (LookupError, ValueError) as e:
        raise SystemExit(str(e)) from e
    if new != local:
        new.write(path)
    return 0


def prepare(argv: list[str], out=None, spark: SparkSession | None = None) -> int:
    """Compiles a zip of records into a registry file."""
    p = argparse.ArgumentParser(prog="bytelore prepare", description="Compiles records into a registry.")
    p.add_argument("-input", help="zip of records; that of the version file otherwise")
    p.add_argument("-output", help="registry file; that of the version file otherwise")
    p.add_argument("-puid", help="only this record")
    p.add_argument("-confdir", default=".", help="folder of the version file")
    args = p.parse_args(argv)
    v = Versions.read(os.path.join(args.confdir, "versions.xml"))
    source = args.input or os.path.join(args.confdir, f"pronom-xml-v{v.pronom_version}.zip")
    target = args.output or os.path.join(args.confdir, v.pronom_signature or "formats.xml")
    n = compiled_file(spark or SparkSession.builder.getOrCreate(), source, target, args.puid)
    print(f"{n} formats compiled", file=sys.stderr)
    return 0


def compiled_file(spark: SparkSession, source: str, target: str, puid: str | None = None) -> int:
    """Writes the registry of a zip of records as one file; the number of its formats."""
    formats = records.compile_records(spark, source, puid)
    registries.write_formats(formats, target)
    return formats.count()


def update(argv: list[str], out=None, client: service.RegistryService | None = None, spark: SparkSession | None = None, wait: Callable[[float], None] = time.sleep) -> int:
    """Downloads the signature file and its records, packs them, writes the version file and compiles the registry."""
    p = argparse.ArgumentParser(prog="bytelore update", description="Downloads and compiles the registry.")
    p.add_argument("-confdir", default=".", help="folder of the registry files")
    p.add_argument("-tmpdir", help="folder of single records; an interrupted download goes on from there")
    p.add_argument("-keep_tmp", action="store_true", help="keep that folder")
    p.add_argument("-http_throttle", type=float, default=0.5, help="seconds between downloads")
    p.add_argument("-version", default="latest", help="version of the signature file")
    args = p.parse_args(argv)
    client, say = client or service.RegistryService(), lambda line: print(line, file=out or sys.stdout)
    version = client.version() if args.version == "latest" else int(args.version.lstrip("v"))
    xml, n = client.signature_file(version)
    with open(os.path.join(args.confdir, f"DROID_SignatureFile-v{version}.xml"), "wb") as f:
        f.write(xml)
    say(f"version {version}: {n} formats")
    folder = args.tmpdir or os.path.join(args.confdir, "tmp")
    os.makedirs(folder, exist_ok=True)
    paths = versions.download_records(versions.puids_of(xml), lambda puid: (200, client.record(puid)), folder, wait=lambda: wait(args.http_throttle))
    archive = os.path.join(args.confdir, f"pronom-xml-v{version}.zip")
    versions.pack_records(paths, archive)
    if not args.keep_tmp:
        shutil.rmtree(folder)
    path = os.path.join(args.confdir, "versions.xml")
    new = versions.updated(Versions.read(path), version)
    new.write(path)
    made = compiled_file(spark or SparkSession.builder.getOrCreate(), archive, os.path.join(args.confdir, new.pronom_signature))
    say(f"{made} formats compiled")
    return 0


def to_xml_main(argv: list[str], out=None, stdin=None) -> int:
    """Lines of standard input as an XML report."""
    p = argparse.ArgumentParser(prog="bytelore toxml", description="Converts lines of the default template to XML.")
    p.add_argument("-confdir", default=".", help="folder of the version file")
    args = p.parse_args(argv)
    to_xml(stdin or sys.stdin, out or sys.stdout, signature_version=Versions.read(os.path.join(args.confdir, "versions.xml")).pronom_version or "")
    return 0


def to_xml(lines, out, program_version: str = __version__, signature_version: str = "") -> None:
    """Lines of the default template, from a file, as an XML report."""
    rows = [dict(zip(report.LINE_ORDER, r, strict=False)) for r in csv.reader(lines) if r]
    out.write(report.xml_text(rows, program_version, signature_version))


COMMANDS = {"prepare": prepare, "update": update, "toxml": to_xml_main}


if __name__ == "__main__":
    sys.exit(main())
