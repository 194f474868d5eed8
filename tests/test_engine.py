import io
import os
import random
import tarfile
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytelore import cli, schema
from bytelore.functions import names, templates
from bytelore.functions.bytesyntax import compile_sequence
from bytelore.operators import matching, registry, report
from bytelore.operators.identify import FormatIdentifier, Options
from bytelore.operators.registry import Compiled, literal
from bytelore.plans import formats as own
from bytelore.plans.made import write_compound
from bytelore.sources import compound as compound_files
from bytelore.sources import archives, objects, records, registries, versions


def frame(spark, rows):
    return spark.createDataFrame([(i, n, bytearray(c)) for i, n, c in rows], "object_id string, filename string, content binary")


def told(df):
    return {(r.object_id, r.filename, r.status, r.puid, r.matchtype) for r in df.collect()}


def row(k, puid, sigs=(), over=(), ext=(), container=None):
    return (k, 0, puid, [], container, puid, None, None, None, list(ext), None, list(over), [(n, [], [(p, "", r) for p, r in pats]) for n, pats in sigs], None)


@pytest.mark.parametrize("name,ext", [("a..b", "b"), (".bashrc", ""), ("A.TXT", "txt"), ("x.zip!foo", "zip!foo"), ("x.zip!d/f.Txt", "txt"), ("d.x/f", ""), ("f.", ""), ("a/.b.c", "c"), ("", ""), ("...", ""), ("a.tar.gz", "gz"), ("x/..y", "")])
def test_extension(spark, name, ext):
    assert names.extension(name) == ext == os.path.splitext(name)[1].lower().lstrip(".")
    assert spark.createDataFrame([(name,)], "n string").select(names.extension_column("n").alias("e")).first().e == ext


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 16, 17, 40])
def test_windows(spark, tmp_path, size):
    data = bytes(range(256))[:size]
    made = matching.objects(frame(spark, [("a", "a", data)]), "object_id", "filename", "content", 8).first()
    want = (size, data[:8], data[-8:])
    assert (made.size, bytes(made.bof), bytes(made.eof)) == want
    (tmp_path / "f").write_bytes(data)
    assert objects.windows_of(str(tmp_path / "f"), 8) == want == objects.stream_windows(io.BytesIO(data), 8)


def test_literal():
    assert literal(compile_sequence("504B0304{2}41")) == (0, b"PK\x03\x04") and literal(compile_sequence("7573", "BOF", "257")) == (257, b"us")
    assert literal(r"(?s)\A(?:a|b)c") is None and literal(r"(?s)\Aab?") == (0, b"a") and literal(r"(?s)\Aab|c") is None and literal("abc") is None and literal(r"(?s)\A.{0,3}ab") is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=10), st.permutations(list(range(6))))
def test_native_fold_equals_the_sequential_one(spark, edges, order):
    over = {k: [f"p{b}" for a, b in edges if a == k] for k in range(6)}
    rows = [row(n, f"p{k}", [("s", [("BOF", "(?s)\\Ax")])], over[k]) for n, k in enumerate(order)]
    made = Compiled([(r[0], r[2], None, frozenset(r[11]), [("s", [("BOF", "(?s)\\Ax")])], frozenset()) for r in rows])
    want = [made.formats[i][1] for i, _ in made.resolve(made.candidates(b"x", b"x"))]
    got = matching.with_candidates(spark.createDataFrame([("o", bytearray(b"x"), bytearray(b"x"))], "object_id string, bof binary, eof binary"), made).select(matching.resolved().alias("m")).first().m
    assert [m.puid for m in got] == want


def test_nontransitive_priority_depends_on_order():
    def run(order, over):
        made = Compiled([(k, p, None, frozenset(over.get(p, ())), [("s", [])], frozenset()) for k, p in enumerate(order)])
        return [made.formats[i][1] for i, _ in made.resolve(made.candidates(b"", b""))]

    assert run("gfh", {"g": "f", "f": "h"}) == ["g", "h"] and run("hfg", {"g": "f", "f": "h"}) == ["g"]


def test_signature_rules(spark):
    rows = [
        row(0, "zero", [("none", [])]), row(1, "odd", [("odd", [("??", "x")])]), row(2, "bad", [("ok", [("BOF", r"(?s)\Aa")]), ("bad", [("BOF", "(")]), ("late", [("BOF", r"(?s)\Aa")])]),
        row(3, "two", [("one", [("BOF", r"(?s)\Aa")]), ("two", [("VAR", "(?s)b")])]), row(4, "far", [("f", [("VAR", "zz")])]), row(5, "both", [("b", [("BOF", r"(?s)\Aa"), ("EOF", r"(?s)q\Z")])]),
    ]
    ident = FormatIdentifier(spark, spark.createDataFrame(rows, schema.FORMAT), None, Options(bufsize=4))
    got = {(r.puid, r.signaturename, r.group_size, r.group_index) for r in ident.content(frame(spark, [("o", "o", b"ab..zz..q")])).collect()}
    assert got == {("zero", "none", 6, 1), ("odd", "odd", 6, 2), ("bad", "ok", 6, 3), ("two", "one", 6, 4), ("two", "two", 6, 5), ("both", "b", 6, 6)}


def test_empty_objects_and_fallback(spark):
    ident = FormatIdentifier(spark, own.formats(spark), own.containers(spark))
    data = frame(spark, [("1", "e.txt", b""), ("2", "e.none", b""), ("3", "x.TXT", b"nothing"), ("4", "p.pdf", b"%PDF-1.4\n%%EOF"), ("5", None, b"?")])
    assert told(ident.content(data)) == {("1", "e.txt", "OK", "own/9", "extension"), ("2", "e.none", "KO", None, "fail"), ("3", "x.TXT", "OK", "own/9", "extension"), ("4", "p.pdf", "OK", "own/2", "signature"), ("5", None, "KO", None, "fail")}
    off = FormatIdentifier(spark, own.formats(spark), None, Options(extension=False))
    assert told(off.content(data)) == {("4", "p.pdf", "OK", "own/2", "signature")}
    assert ident.content(data.limit(0)).count() == 0


def compound(streams, shift=9):
    raw = io.BytesIO()
    write_compound(raw, streams, shift)
    return raw.getvalue()


def zipped(items):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for n, b in items:
            z.writestr(n, b)
    return raw.getvalue()


def tarred(items):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for n, b in items:
            info = tarfile.TarInfo(n)
            info.size = len(b)
            t.addfile(info, io.BytesIO(b))
    return raw.getvalue()


def test_compound_file_and_deep_scan(spark):
    doc = compound([("\x01CompObj", b"xx Word.Document.8 yy"), ("Other", b"z")])
    assert [p for p, _ in archives.CompoundFile(doc).streams()] == ["\x01CompObj", "Other"]
    ident = FormatIdentifier(spark, own.formats(spark), own.containers(spark), Options(archives=True))
    data = frame(spark, [("1", "d.doc", doc), ("2", "n.doc", compound([("Other", b"z")])), ("3", "w.bin", zipped([("[Content_Types].xml", b"wordprocessingml"), ("a.txt", b"x")])), ("4", "broken.zip", b"PK\x03\x04junk"), ("5", "o.bin", doc[:600])])
    assert told(ident.content(data)) == {("1", "d.doc", "OK", "own/25", "container"), ("2", "n.doc", "OK", "fmt/111", "signature"), ("3", "w.bin", "OK", "own/23", "container"), ("4", "broken.zip", "OK", "x-fmt/263", "signature"), ("5", "o.bin", "OK", "fmt/111", "signature")}


def test_members(spark):
    ident = FormatIdentifier(spark, own.formats(spark), own.containers(spark), Options(archives=True))
    inner = zipped([("deep.txt", b"x"), ("p", b"\x89PNG\r\n\x1a\n")])
    outer = zipped([("in.zip", inner), ("empty", b""), ("t.tar", tarred([("m.bin", b"GIF89a"), ("n.txt", b"n")])), ("q", b"?")])
    got = told(ident.content(frame(spark, [("1", "o.zip", outer)])))
    assert got == {
        ("1", "o.zip", "OK", "x-fmt/263", "signature"), ("1", "o.zip!in.zip", "OK", "x-fmt/263", "signature"), ("1", "o.zip!in.zip!deep.txt", "OK", "own/9", "extension"), ("1", "o.zip!in.zip!p", "OK", "own/3", "signature"),
        ("1", "o.zip!t.tar", "OK", "x-fmt/265", "signature"), ("1", "o.zip!t.tar!m.bin", "OK", "own/6", ""), ("1", "o.zip!t.tar!n.txt", "KO", None, "fail"), ("1", "o.zip!q", "KO", None, "fail"),
    }
    broken = archives.members("b.zip", b"PK\x03\x04junk", "zip", ident.registry, Options())
    assert broken == []


def test_members_of_any_depth_and_size(spark):
    ident = FormatIdentifier(spark, own.formats(spark), own.containers(spark), Options(archives=True))
    data = b"GIF89a"
    for k in range(12):
        data = zipped([("in", data)]) if k % 2 else tarred([("in", data)])
    rows = archives.members("o", data, "zip", ident.registry, Options())
    assert len(rows) == 12 and rows[-1][0] == "o" + "!in" * 12 and [m["puid"] for m in rows[-1][3]] == ["own/6"]
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        with z.open("big", "w", force_zip64=True) as f:
            for _ in range(1025):
                f.write(bytes(1 << 20))
        z.writestr("last", b"GIF89a")
    rows = archives.members("o", raw.getvalue(), "zip", ident.registry, Options())
    assert [r[1] for r in rows] == [1025 << 20, 6] and [m["puid"] for m in rows[-1][3]] == ["own/6"]
    cut = tarred([("a", b"GIF89a" * 300), ("b", b"GIF89a" * 300)])[:3000]
    assert [r[0] for r in archives.members("t", cut, "tar", ident.registry, Options())][:1] == ["t!a"]


def test_registry_files(spark, tmp_path):
    xml = """<?xml version="1.0"?><formats version="0.3">
      <format><puid>a/1</puid><mime>m/1</mime><mime>m/2</mime><name>First</name><version>1.0</version><extension>one</extension><apple_uti>u.t.i</apple_uti><has_priority_over>a/2</has_priority_over>
        <signature><name>s</name><pattern><position>BOF</position><regex>(?s)\\AA </regex></pattern></signature></format>
      <format><puid>a/2</puid><name>Second</name></format></formats>"""
    more = '<formats version="0.3"><format><puid>a/2</puid><name>New second</name><container>zip</container></format><format><puid>a/3</puid><name>Third</name></format></formats>'
    (tmp_path / "a.xml").write_text(xml)
    (tmp_path / "b.xml").write_text(more)
    both = registries.read_registry(spark, str(tmp_path / "a.xml"), str(tmp_path / "b.xml"))
    rows = both.orderBy("ord").collect()
    assert [(r.puid, r.name) for r in rows] == [("a/1", "First"), ("a/2", "New second"), ("a/3", "Third")]
    assert rows[0].signature[0].pattern[0].regex == "(?s)\\AA " and rows[0].version == "1.0" and rows[0].mime == ["m/1", "m/2"] and rows[0].apple_uti == "u.t.i"
    ident = FormatIdentifier(spark, both, None, Options(containers=False))
    got = ident.content(frame(spark, [("1", "x", b"A b"), ("2", "x", b"Ab")])).collect()
    assert {(r.object_id, r.puid, r.mimetype, r.version, r.apple_uti) for r in got} == {("1", "a/1", "m/1", "1.0", "u.t.i"), ("2", None, None, None, None)}
    registries.write_formats(both, str(tmp_path / "out"))
    back = registries.read_formats(spark, str(tmp_path / "out")).orderBy("ord").collect()
    assert [(r.puid, r.signature) for r in back] == [(r.puid, r.signature) for r in rows]


def test_container_file(spark, tmp_path):
    seq = lambda s: f"<BinarySignatures><InternalSignatureCollection><InternalSignature><ByteSequence><SubSequence><Sequence>{s}</Sequence></SubSequence></ByteSequence></InternalSignature></InternalSignatureCollection></BinarySignatures>"
    (tmp_path / "c.xml").write_text(
        f"""<M><ContainerSignatures><ContainerSignature Id="1" ContainerType="ZIP"><Files><File><Path>a</Path>{seq("'x' 41")}</File></Files></ContainerSignature>
        <ContainerSignature Id="2" ContainerType="ZIP"><Files><File><Path>b</Path></File></Files></ContainerSignature></ContainerSignatures>
        <FileFormatMappings><FileFormatMapping signatureId="1" Puid="p/1"/><FileFormatMapping signatureId="1" Puid="p/9"/><FileFormatMapping signatureId="2" Puid="p/2"/></FileFormatMappings></M>"""
    )
    assert [(r.container_type, r.sig_id, r.puid, r.path, r.regex) for r in registries.read_containers(spark, str(tmp_path / "c.xml")).collect()] == [("ZIP", "1", "p/1", "a", "(?s)xA")]


def test_registries_of_several_files_and_splits(spark, tmp_path):
    """Elements count in the order of files and of places in them, however the files are split."""
    seq = lambda s: f"<BinarySignatures><InternalSignatureCollection><InternalSignature><ByteSequence><SubSequence><Sequence>{s}</Sequence></SubSequence></ByteSequence></InternalSignature></InternalSignatureCollection></BinarySignatures>"
    (tmp_path / "f").mkdir()
    (tmp_path / "c").mkdir()
    for n, size in (("a", 40), ("b", 700), ("c", 90)):
        (tmp_path / f"f/{n}.xml").write_text("<formats>" + "".join(f"<format>\n<puid>{n}/{k}</puid><name>{'x' * (k % 50)}</name></format>\n" for k in range(size)) + "</formats>")
        signature = "".join(f'<ContainerSignature Id="{n}{k}" ContainerType="ZIP"><Files><File><Path>p{k}</Path>{seq(41)}</File></Files></ContainerSignature>\n' for k in range(size))
        mapping = "".join(f'<FileFormatMapping signatureId="{n}{k}" Puid="{n}/{k}"/>\n<FileFormatMapping signatureId="a{k}" Puid="late/{k}"/>\n' for k in range(size))
        (tmp_path / f"c/{n}.xml").write_text(f"<M><S>{signature}</S><T>{mapping}</T></M>")
    want = [f"{n}/{k}" for n, size in (("a", 40), ("b", 700), ("c", 90)) for k in range(size)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = registries.read_formats(spark, str(tmp_path / "f"))
        assert [(r.ord, r.puid) for r in found.orderBy("ord").collect()] == list(enumerate(want))
        both = registry.combine(found, found.where("puid LIKE 'b/%'").withColumn("name", registry.F.lit("new")))
        assert [(r.puid, r.name == "new") for r in both.orderBy("ord").collect()] == [(p, p[0] == "b") for p in want]
        found = registries.read_containers(spark, str(tmp_path / "c"))
        assert [(r.ord, r.puid) for r in found.orderBy("ord").collect()] == list(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


RECORD = """<PRONOM-Report xmlns="http://pronom.nationalarchives.gov.uk"><report_format_detail><FileFormat><FormatID> {id} </FormatID><FormatName>N{id}</FormatName><FormatVersion>1</FormatVersion>
<FileFormatIdentifier><Identifier>fmt/{id}</Identifier><IdentifierType>PUID</IdentifierType></FileFormatIdentifier><FileFormatIdentifier><Identifier>m/{id}</Identifier><IdentifierType>MIME</IdentifierType></FileFormatIdentifier>
<ExternalSignature><Signature>e{id}</Signature></ExternalSignature><RelatedFormat><RelationshipType>Has priority over</RelationshipType><RelatedFormatID>{over}</RelatedFormatID></RelatedFormat>{sigs}</FileFormat></report_format_detail></PRONOM-Report>"""
SIG = "<InternalSignature><SignatureName>{n}</SignatureName><ByteSequence><PositionType>Absolute from BOF</PositionType><ByteSequenceValue>{s}</ByteSequenceValue><Offset>0</Offset></ByteSequence></InternalSignature>"


def test_records(spark, tmp_path):
    sigs = SIG.format(n="a", s="41") + SIG.format(n="bad", s="4Z") + SIG.format(n="b", s="42")
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("puid.fmt.2.xml", RECORD.format(id=2, over=1, sigs=sigs))
        z.writestr("puid.fmt.1.xml", RECORD.format(id=1, over=77, sigs=SIG.format(n="c", s="43")))
    rows = records.compile_records(spark, str(tmp_path / "r.zip")).orderBy("ord").collect()
    assert [(r.puid, r.has_priority_over, [s.name for s in r.signature], r.extension, r.pronom_id) for r in rows] == [("fmt/2", ["fmt/1"], ["b"], ["e2"], "2"), ("fmt/1", ["77"], ["c"], ["e1"], "1")]
    one = records.compile_records(spark, str(tmp_path / "r.zip"), "fmt/2").collect()
    assert [(r.puid, r.has_priority_over) for r in one] == [("fmt/2", ["1"])]


def test_versions(tmp_path):
    assert versions.Versions.read(str(tmp_path / "none.xml")) == versions.Versions()
    v = versions.Versions("10", "a.xml", "c.xml", "e.xml", "1", "https://site")
    v.write(str(tmp_path / "v.xml"))
    assert versions.Versions.read(str(tmp_path / "v.xml")) == v
    with pytest.raises(ValueError):
        versions.Versions("10").write(str(tmp_path / "w.xml"))
    calls = []

    def fetch(url):
        calls.append(url)
        return (200, b'<signature version="v12"/>') if "v9" not in url else (404, b"")

    site, said = versions.UpdateSite("https://site", fetch), []
    new = versions.act("update", v, site, str(tmp_path), said.append)
    assert new.pronom_version == "12" and (tmp_path / "formats-v12.xml").exists()
    versions.act("check", new, site, str(tmp_path), said.append)
    assert said == ["the registry is up to date"]
    with pytest.raises(LookupError):
        versions.act("v9", v, site, str(tmp_path))
    with pytest.raises(ValueError):
        versions.act("x9", v, site, str(tmp_path))
    got = versions.download_records(["fmt/1", "fmt/2"], lambda p: (200, p.encode()) if p == "fmt/1" else (500, b""), str(tmp_path))
    versions.pack_records(got, str(tmp_path / "p.zip"))
    assert zipfile.ZipFile(tmp_path / "p.zip").namelist() == ["puid.fmt.1.xml"]


def test_files_lines_and_command_line(spark, tmp_path):
    (tmp_path / "d/sub").mkdir(parents=True)
    (tmp_path / "d/a.txt").write_text("x")
    (tmp_path / "d/empty.bin").write_bytes(b"")
    (tmp_path / "d/sub/g").write_bytes(b"GIF89a")
    (tmp_path / "d/z.zip").write_bytes(zipped([("i.txt", b"i")]))
    listed = lambda *roots, **o: sorted(r.path for r in objects.expanded(spark.createDataFrame([(x,) for x in roots], "path string"), **o).collect())
    assert listed(f"{tmp_path}/d\n", str(tmp_path / "missing"), f"file://{tmp_path}/d/sub/g") == [str(tmp_path / "d" / n) for n in ("a.txt", "empty.bin", "sub/g", "z.zip")]
    assert listed(f"file://{tmp_path}/d", recurse=True) == [str(tmp_path / "d" / n) for n in ("a.txt", "empty.bin", "sub/g", "z.zip")]
    out = io.StringIO()
    assert cli.main(["-q", "-recurse", "-zip", "-matchprintf", "%(info.puid)s %(info.matchtype)s %(info.group_index)d/%(info.group_size)d\\n", "-nomatchprintf", "none %(info.filesize)s\\n", str(tmp_path / "d")], spark, out) == 0
    assert out.getvalue().splitlines() == ["own/9 extension 1/1", "none 0", "own/6 signature 1/2", "own/6 signature 2/2", "x-fmt/263 signature 1/1", "own/9 extension 1/1"]
    assert cli.main([], spark, io.StringIO()) == 1 and cli.main(["-v"], spark, io.StringIO()) == 0
    ident = FormatIdentifier(spark, own.formats(spark), None, Options(containers=False))
    results = ident.content(frame(spark, [("1", 'q"x.png', b"\x89PNG\r\n\x1a\n")])).withColumn("time_ms", report.F.lit(3))
    assert report.lines(results).first().line == 'OK,3,own/3,"Portable Network Graphics","PNG header",8,"q"x.png","image/png","signature"\n'
    assert list(objects.framed(io.BytesIO(b"content-length: 3\r\n\r\nabccontent-length:2\n\nde"))) == [b"abc", b"de"]
    xml = io.StringIO()
    cli.to_xml(['OK,3,own/3,"N<","S",8,"f","m","signature"'], xml)
    assert "<formatname>N&lt;</formatname>" in xml.getvalue()
    with pytest.raises(KeyError):
        templates.line("%(info.nothing)s")


def test_stream_of_unknown_length(spark):
    ident = FormatIdentifier(spark, own.formats(spark), None)
    got = ident.objects(objects.object_of_stream(spark, io.BytesIO(b"%PDF-1.4\n" + b"x" * 300 + b"%%EOF"), "n.txt", 64), stream=True).collect()
    assert [(r.puid, r.filesize, r.filename) for r in got] == [("own/2", 314, "STDIN")]
    for name, link, puid in (("n.txt", None, "own/9"), ("n.txt", "/x/y.pdf", "own/2"), (None, None, None)):  # the name, and before it the link, only give the extension
        made = objects.object_of_stream(spark, io.BytesIO(b"plain"), name, 64, link)
        got = ident.objects(made, stream=True, extension_of="extension_of").collect()
        assert {(r.filename, r.matchtype) for r in got} == {("STDIN", "extension" if puid else "fail")} and puid in {r.puid for r in got}


def test_arriving_files(spark, tmp_path):
    from bytelore.streaming.files import arriving, write_arriving

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.gif").write_bytes(b"GIF87a")
    (tmp_path / "in/b.txt").write_bytes(b"x")
    ident = FormatIdentifier(spark, own.formats(spark), None, Options(containers=False))
    write_arriving(arriving(ident, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination(60)
    assert {(os.path.basename(r.filename), r.puid) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a.gif", "own/5"), ("a.gif", "own/6"), ("b.txt", "own/9")}


def test_native_predicates_equal_the_exact_ones(spark):
    made = Compiled([f for f in registry.compiled(own.formats(spark)).formats])
    data = [b"%PDF-1.4\n%%EOF", b"GIF89a", b"gf", b"M\x07\xf0AE^", b"II*\0", b"\x89PNG\r\n\x1a\n", b"a\nAll rights reserved.", b"\xff\xd8\xff\xe1..\xff\xd9", b"\xff\xd8\xff\xe1..\xff\xd9\n", b""]
    df = matching.objects(frame(spark, [(str(i), "n", d) for i, d in enumerate(data)]), "object_id", "filename", "content")
    pick = lambda d: {(r.object_id, tuple(c.puid for c in r.candidates)) for r in d.collect()}
    assert pick(matching.native_candidates(df, made)) == pick(matching.with_candidates(df, made))


def test_notes_of_damaged_archives_and_broken_expressions(spark, capsys, tmp_path):
    whole = zipped([("a.gif", b"GIF89a" * 99), ("in.zip", b"PK\x03\x04" + b"x" * 50)])
    cases = [("1", "good.zip", zipped([("a", b"x")])), ("2", "cut.zip", whole[: len(whole) // 2]), ("3", "nested.zip", whole), ("4", "bad.tar", tarred([("a", b"x" * 2000)])[:1200]), ("5", "x.gif", b"GIF89a")]
    ident = FormatIdentifier(spark, own.formats(spark), own.containers(spark), Options(archives=True))
    got = ident.content(frame(spark, cases)).where("path = ''").select("object_id", "note").distinct().collect()
    assert {r.object_id for r in got if r.note} == {"2", "3", "4"}, got
    (tmp_path / "cut.zip").write_bytes(whole[: len(whole) // 2])
    out = io.StringIO()
    assert cli.main(["-zip", str(tmp_path / "cut.zip")], spark, out) == 0
    said = capsys.readouterr().err
    assert "cut.zip" in said and "Processed 1 files" in said and "x-fmt/263" in out.getvalue()


def test_one_python_stage_looks_into_archives(spark):
    ident = FormatIdentifier(spark, own.formats(spark), own.containers(spark), Options(archives=True))
    plan = ident.content(frame(spark, [("1", "a.zip", b"x")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_running_count(spark, tmp_path):
    for n in ("b.gif", "a.gif", "c.zip"):
        (tmp_path / n).write_bytes(zipped([("i.gif", b"GIF87a"), ("j.gif", b"GIF87a")]) if n == "c.zip" else b"GIF89a")
    out = io.StringIO()
    assert cli.main(["-q", "-zip", "-matchprintf", "%(info.count)d %(info.puid)s\n", "-nomatchprintf", "", str(tmp_path)], spark, out) == 0
    assert [x.split()[0] for x in out.getvalue().splitlines()] == ["1", "1", "2", "2", "3", "4", "4", "5", "5"]


ONE_RECORD = """<PRONOM-Report xmlns="http://pronom.nationalarchives.gov.uk"><report_format_detail><FileFormat><FormatID>1</FormatID><FormatName>N</FormatName><FileFormatIdentifier><Identifier>fmt/7</Identifier><IdentifierType>PUID</IdentifierType></FileFormatIdentifier>
<InternalSignature><SignatureName>S</SignatureName><ByteSequence><PositionType>Absolute from BOF</PositionType><ByteSequenceValue>4142</ByteSequenceValue></ByteSequence></InternalSignature></FileFormat></report_format_detail></PRONOM-Report>"""


def test_prepare_update_and_versions_commands(spark, tmp_path):
    import zipfile

    from bytelore.sources import service, versions

    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        z.writestr("puid.fmt.7.xml", ONE_RECORD)
    assert cli.prepare(["-input", str(tmp_path / "in.zip"), "-output", str(tmp_path / "out.xml")], spark=spark) == 0
    assert [(r.puid, r.signature[0].pattern[0].regex) for r in registries.read_formats(spark, str(tmp_path / "out.xml")).collect()] == [("fmt/7", "(?s)\\AAB")]

    answers = {service.SERVICE: f"<v xmlns='{service.NAMESPACE}'><Version><Version>120</Version></Version></v>", service.SIGNATURES.format(version=120): "<F xmlns='urn:x'><FileFormat PUID='fmt/7'/></F>", service.RECORDS.format(puid="fmt/7"): ONE_RECORD}
    client, waited = service.RegistryService(lambda url, body, headers: (200, answers[url].encode())), []
    assert cli.update(["-confdir", str(tmp_path), "-http_throttle", "0.25"], io.StringIO(), client, spark, waited.append) == 0
    local = versions.Versions.read(str(tmp_path / "versions.xml"))
    assert (local.pronom_version, local.pronom_signature, waited) == ("120", "formats-v120.xml", [0.25]) and not (tmp_path / "tmp").exists()
    assert [r.puid for r in registries.read_formats(spark, str(tmp_path / "formats-v120.xml")).collect()] == ["fmt/7"]

    local.update_site = "http://site/"
    local.write(str(tmp_path / "versions.xml"))
    site = {"http://site/format/": b"<s><signature version='v121'/></s>", "http://site/format/latest/": b"<signature version='121'/>", "http://site/format/v121/": b""} | {f"http://site/format/v121/{k}/": b"x" for k in ("formats", "droid", "pronom")}
    fetch = lambda url: (200, site[url]) if url in site else (404, b"")
    out = io.StringIO()
    for action in ("list", "check", "update", "check"):
        assert cli.main(["-sigs", action, "-confdir", str(tmp_path)], spark, out, fetch) == 0
    assert out.getvalue().splitlines() == ["v121", "version 121 is available", "the registry is up to date"]
    assert versions.Versions.read(str(tmp_path / "versions.xml")).pronom_version == "121"
    with pytest.raises(SystemExit):
        cli.main(["-sigs", "v7", "-confdir", str(tmp_path)], spark, out, fetch)
    xml = io.StringIO()
    assert cli.to_xml_main(["-confdir", str(tmp_path)], xml, ['OK,3,own/3,"N","S",8,"f","m","signature"']) == 0 and "<signature_version>121<" in xml.getvalue()


def test_lines_written_by_tasks(spark, tmp_path):
    (tmp_path / "a.gif").write_bytes(b"GIF89a")
    (tmp_path / "list").write_text(f"{tmp_path}/a.gif\n{tmp_path}/missing\n")
    assert cli.main(["-q", "-input", str(tmp_path / "list"), "-outdir", str(tmp_path / "out")], spark, io.StringIO()) == 0
    assert sorted(r.puid for r in report.read_lines(spark, str(tmp_path / "out")).collect()) == ["own/6", "own/6"]


def test_batches_of_arriving_files_go_to_a_handler(spark, tmp_path):
    from bytelore.streaming.files import arriving, write_arriving

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.gif").write_bytes(b"GIF87a")
    seen = []
    ident = FormatIdentifier(spark, own.formats(spark), None, Options(containers=False))
    query = write_arriving(arriving(ident, str(tmp_path / "in")), None, str(tmp_path / "check"), handler=lambda df, n: seen.extend(r.puid for r in df.collect()))
    query.awaitTermination()
    assert sorted(seen) == ["own/5", "own/6"]


def test_members_of_split_archives_equal_the_walk(spark, tmp_path, monkeypatch):
    """Ranges of three members; nested archives, damaged members and a tar in a zip."""
    monkeypatch.setattr(archives, "MEMBERS_EACH", 3)
    inner = zipped([(f"d{k}.txt", b"t%d" % k) for k in range(5)] + [("deep.zip", zipped([("x.gif", b"GIF89a")])), ("t.tar", tarred([("m.bin", b"%PDF-1.7"), ("n", b"plain")]))])
    items = [(f"f{k}.png", b"\x89PNG\r\n\x1a\n" + bytes([k])) for k in range(7)] + [("empty", b""), ("in.zip", inner), ("cut.zip", inner[:60]), ("none", b"zz")]
    raw = bytearray(zipped(items))
    (tmp_path / "a.zip").write_bytes(bytes(raw))
    (tmp_path / "b.tar").write_bytes(tarred(items))
    (tmp_path / "c.zip").write_bytes(bytes(raw[:100]))
    (tmp_path / "d.zip").write_bytes(b"PK\x05\x06" + bytes(18))
    bad = bytes(raw).replace(b"\x89PNG\r\n\x1a\n\x03", b"\x89PNG\r\n\x1a\n\x09")
    (tmp_path / "e.zip").write_bytes(bad)
    paths = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("a.zip", "b.tar", "c.zip", "d.zip", "e.zip")], "path string")
    told = []
    for split in (False, True):
        ident = FormatIdentifier(spark, own.formats(spark), own.containers(spark), Options(archives=True, split=split))
        told.append(sorted((r.object_id, r.path, r.filename, r.status, r.puid, r.signaturename, r.filesize, r.matchtype, r.group_size, r.group_index) for r in ident.files(paths).drop("time_ms").collect()))
        told[-1] = [tuple("" if x is None else x for x in r) for r in told[-1]]
    assert told[0] == told[1] and sum("in.zip!" in r[2] for r in told[1]) > 10 and any("t.tar!n" in r[2] for r in told[1])
    notes = {r.filename.rsplit("/", 1)[1]: r.note for r in ident.files(paths).where("note IS NOT NULL").collect()}
    assert set(notes) == {"a.zip!cut.zip", "b.tar!cut.zip", "c.zip", "e.zip!cut.zip", "e.zip!f3.png"} and "checksum" in notes["e.zip!f3.png"]


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_members_are_read_by_ranges(tmp_path, method):
    from bytelore.sources import zips

    big = b"".join(b"%d line\n" % k for k in range(400_000))
    raw = io.BytesIO(b"")
    with zipfile.ZipFile(raw, "w", method) as z:
        for name, data in (("a", b"x" * 5), ("ä/b", big), ("zeros", bytes(3 << 20)), ("e", b"")):
            z.writestr(name, data)
    f = io.BytesIO(b"before" + raw.getvalue())
    found = list(zips.entries(f, zips.directory(f)))
    assert [(e.name, e.size) for _, e in found] == [("a", 5), ("ä/b", len(big)), ("zeros", 3 << 20), ("e", 0)]
    assert b"".join(zips.pieces(f, found[1][1])) == big and all(len(p) <= zips.PIECE for p in zips.pieces(f, found[2][1]))
    assert [e.name for _, e in zips.entries(f, zips.directory(f), found[2][0], 2)] == ["zeros", "e"]
    for name in ("p", "q"):
        (tmp_path / name).write_bytes(raw.getvalue())
    zips.joined([str(tmp_path / "p"), str(tmp_path / "q")], str(tmp_path / "joined"))
    with zipfile.ZipFile(tmp_path / "joined") as z:
        assert z.namelist() == ["a", "ä/b", "zeros", "e"] * 2 and z.testzip() is None


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    from bytelore.sources import single

    rows = spark.range(10).selectExpr("cast(id AS string) AS name", "encode(if(id = 7, raise_error('no'), 'x'), 'UTF-8') AS content")
    with pytest.raises(Exception, match="no"):
        single.write_zip(rows, str(tmp_path / "z.zip"))
    assert os.listdir(tmp_path) == []
    single.write_zip(rows.where("id <> 7"), f"file://{tmp_path}/z.zip")
    assert sorted(os.listdir(tmp_path)) == ["z.zip"] and len(zipfile.ZipFile(tmp_path / "z.zip").namelist()) == 9
    single.write_zip(rows.where("id > 70"), str(tmp_path / "none.zip"))
    assert zipfile.ZipFile(tmp_path / "none.zip").namelist() == [] and single.read_zip(spark, str(tmp_path / "none.zip")).count() == 0


@pytest.mark.parametrize("shift", [9, 12])
def test_streams_of_compound_files(spark, shift):
    rng = random.Random(shift)
    streams = [("short", b"abc"), ("none", b""), ("edge", bytes(range(256)) * 16), ("below", b"x" * 4095), ("A/inner", rng.randbytes(70_000)), ("A/B/deep", b"d" * 64), ("A/B/long", rng.randbytes(9_000)), ("last", b"z" * 65)]
    doc = compound(streams, shift)
    whole = archives.CompoundFile(doc)
    assert {p: whole.read(e) for p, e in whole.streams()} == dict(streams)
    found = compound_files.streams_of(frame(spark, [("1", "n", doc), ("2", "n", doc[: len(doc) // 2]), ("3", "n", b""), ("4", "n", b"junk" * 900)]))
    assert {(r.path, bytes(r.content)) for r in found.where("object_id = '1'").collect()} == set(streams)
    for k in range(300):  # damage must end, not hang
        cut = bytearray(doc[: rng.randrange(len(doc))] if k % 2 else doc)
        for _ in range(k % 7):
            if cut:
                cut[rng.randrange(min(len(cut), 1 << shift + 1))] = rng.randrange(256)
        assert isinstance(archives.container_hits(bytes(cut), "OLE2", [("OLE2", "short", "p", "a")]), list)


def test_a_large_compound_file_is_sought_in(tmp_path):
    import tracemalloc

    for shift, size in ((9, 60 << 20), (12, 1 << 30)):
        path = tmp_path / f"large{shift}"
        with open(path, "wb") as f:
            write_compound(f, [("Huge", size), ("\x01CompObj", b"Word.Document.8" + b" " * 9000), ("small", b"s")], shift)
        tracemalloc.start()
        with open(path, "rb") as f:
            assert archives.container_hits(f, "OLE2", [("OLE2", "CompObj", "own/25", "Word")]) == ["own/25"]
            whole = archives.CompoundFile(f)
            entry = dict(whole.streams())["Huge"]
            n = sum(len(p) for p in whole.pieces(entry)) if shift == 9 else entry.size
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == size and peak < 6 << 20, peak


def test_both_ways_of_resolving_agree(spark):
    """The walk in tasks and the fold, joins and look-ups in Spark, over the same objects."""
    from bytelore.plans import catalog

    rows = spark.createDataFrame([(k, f"text {k} {'All rights reserved.' if k % 7 == 0 else ''}", f"s{k % 3}") for k in range(400)], "doc_id long, text string, source string")
    spark_dir = catalog._table
    try:
        catalog._table = lambda *_: rows
        made = catalog.objects_of(spark, "")
    finally:
        catalog._table = spark_dir
    for extension in (True, False):
        told_by = []
        for inside in (True, False):
            ident = FormatIdentifier(spark, own.formats(spark), own.containers(spark) if inside else None, Options(containers=inside, extension=extension))
            told_by.append(sorted(map(repr, ident.content(made).drop("time_ms", "note").collect())))
        assert told_by[0] == told_by[1] and len(told_by[0]) > 300


def test_a_stream_of_frames_goes_on_from_its_checkpoint(spark, tmp_path):
    from bytelore.sources import framed

    whole = b"".join(b"content-length: %d\n\n%s" % (n, b"x" * n) for n in (0, 5, 70_000, 3, 9, 40))
    ends = [len(whole) * k // 5 for k in range(1, 6)]
    for end in ends:
        (tmp_path / "f").write_bytes(whole[:end])
        query = framed.stream_frames(spark, str(tmp_path / "f"), 16, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.size for r in got) == [0, 3, 5, 9, 40, 70_000] and all(len(r.bof) == min(16, r.size) for r in got)
    assert sorted(r.filename for r in framed.read_frames(spark, str(tmp_path / "f"), 16, 4).collect()) == sorted(r.filename for r in got)


def test_files_of_another_store(tmp_path, monkeypatch):
    """Arrow's file systems instead of the system's own calls."""
    from bytelore.sources import store

    monkeypatch.setattr(store, "local", lambda name: None)
    (tmp_path / "d").mkdir()
    (tmp_path / "d/f").write_bytes(b"0123456789")
    uri = f"file://{tmp_path}"
    assert sorted(store.level(uri)) == [(f"{uri}/d", True)] and list(store.level(f"{uri}/d/f")) == [(f"{uri}/d/f", False)] and list(store.level(f"{uri}/none")) == []
    assert store.windows_of(f"{uri}/d/f", 3) == (10, b"012", b"789") and store.windows_of(f"{uri}/d/f", 20)[2] == b"0123456789"
    with store.created(f"{uri}/new/g") as f:
        f.write(b"a\nb\n")
    store.moved(f"{uri}/new/g", f"{uri}/h")
    with store.opened(f"{uri}/h") as f:
        assert [f.readline(), f.readline(), f.readline()] == [b"a\n", b"b\n", b""]
    store.deleted(f"{uri}/d")
    store.deleted(f"{uri}/none")
    assert sorted(os.listdir(tmp_path)) == ["h", "new"]
