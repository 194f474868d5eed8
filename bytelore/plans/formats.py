"""The engine's own small registry, written from publicly known magic numbers."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

from bytelore import schema
from bytelore.functions.bytesyntax import compile_sequence
from bytelore.functions.containersyntax import compile_container_sequence

#: Fixed values: (puid, name, version, mime, container, extensions, priorities, [(signature, [(position, sequence, offset, max offset)])]).
FORMATS = [
    ("x-fmt/263", "ZIP Format", "", "application/zip", "zip", ["zip"], [], [("ZIP local header", [("BOF", "504B0304", "0", "0")])]),
    ("x-fmt/265", "Tape Archive Format", "", "application/x-tar", "tar", ["tar"], [], [("ustar", [("BOF", "7573746172", "257", "0")])]),
    ("fmt/111", "OLE2 Compound Document Format", "", None, None, [], [], [("CFB header", [("BOF", "D0CF11E0A1B11AE1", "0", "0")])]),
    ("own/1", "Portable Document Format", "", "application/pdf", None, ["pdf"], [], [("PDF header", [("BOF", "255044462D", "0", "1024")])]),
    ("own/2", "Portable Document Format", "1.4", "application/pdf", None, ["pdf"], ["own/1"], [("PDF 1.4 with trailer", [("BOF", "255044462D312E34", "0", "0"), ("EOF", "2525454F46", "0", "1024")])]),
    ("own/3", "Portable Network Graphics", "", "image/png", None, ["png"], [], [("PNG header", [("BOF", "89504E470D0A1A0A", "0", "0")])]),
    ("own/4", "JPEG File Interchange", "", "image/jpeg", None, ["jpg", "jpeg"], [], [("JFIF", [("BOF", "FFD8FF[E0:EF]", "0", "0"), ("EOF", "FFD9", "0", "0")])]),
    ("own/5", "Graphics Interchange Format", "87a", "image/gif", None, ["gif"], [], [("GIF87a", [("BOF", "474946383761", "0", "0")])]),
    ("own/6", "Graphics Interchange Format", "89a", "image/gif", None, ["gif"], [], [("GIF89a", [("BOF", "474946383961", "0", "0")]), ("GIF8 any", [("BOF", "47494638(37|39)61", "0", "0")])]),
    ("own/7", "Rich Text Format", "", "text/rtf", None, ["rtf"], [], [("RTF", [("BOF", "7B5C727466", "0", "0")])]),
    ("own/8", "Rich Text Format", "1", "text/rtf", None, ["rtf"], ["own/7"], [("RTF 1", [("BOF", "7B5C72746631", "0", "0")])]),
    ("own/9", "Plain Text File", "", "text/plain", None, ["txt", "text"], [], []),
    ("own/10", "Hypertext Markup Language", "", "text/html", None, ["html", "htm"], [], [("doctype", [("BOF", "3C21(44|64)(4F|6F)(43|63)(54|74)(59|79)(50|70)(45|65)20(48|68)(54|74)(4D|6D)(4C|6C)", "0", "0")])]),
    ("own/11", "Hypertext Markup Language, complete", "", "text/html", None, ["html"], ["own/10"], [("doctype and end", [("BOF", "3C21(44|64)(4F|6F)(43|63)(54|74)(59|79)(50|70)(45|65)20(48|68)(54|74)(4D|6D)(4C|6C)", "0", "0"), ("EOF", "3C2F(48|68)(54|74)(4D|6D)(4C|6C)3E", "0", "16")])]),
    ("own/12", "Extensible Markup Language", "1.0", "text/xml", None, ["xml"], [], [("declaration", [("BOF", "3C3F786D6C2076657273696F6E3D", "0", "0")])]),
    ("own/13", "GZIP Format", "", "application/gzip", None, ["gz", "tgz"], [], [("GZIP", [("BOF", "1F8B08", "0", "0")])]),
    ("own/14", "Waveform Audio", "", "audio/x-wav", None, ["wav"], [], [("RIFF WAVE", [("BOF", "52494646{4}57415645", "0", "0")])]),
    ("own/15", "Tagged Image File Format", "", "image/tiff", None, ["tif", "tiff"], [], [("little", [("BOF", "49492A00", "0", "0")]), ("big", [("BOF", "4D4D002A", "0", "0")])]),
    ("own/16", "Comma Separated Values", "", "text/csv", None, ["csv"], [], []),
    ("own/17", "Priority probe g", "", None, None, [], ["own/18"], [("g", [("BOF", "6766", "0", "0")])]),
    ("own/18", "Priority probe f", "", None, None, [], ["own/19"], [("f", [("BOF", "6766", "0", "0")])]),
    ("own/19", "Priority probe h", "", None, None, [], [], [("h", [("BOF", "6766", "0", "0")])]),
    ("own/20", "License text", "", "text/plain", None, ["lic"], [], [("rights", [("VAR", "416C6C207269676874732072657365727665642E", "0", "0")])]),
    ("own/21", "Masked probe", "", None, None, ["msk"], [], [("bits", [("BOF", "4D&07~F0[!00]*455E", "0", "0")])]),
    ("own/22", "Indirect probe", "", None, None, [], [], [("indirect", [("IFB", "49464258", "2", "0")])]),
    ("own/23", "Office Open XML document", "", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", None, ["docx"], [], []),
    ("own/24", "OpenDocument text", "", "application/vnd.oasis.opendocument.text", None, ["odt"], [], []),
    ("own/25", "Legacy word-processing document", "", "application/msword", None, ["doc"], [], []),
]

#: Fixed values: (container type, id, puid, path, sequence).
CONTAINERS = [
    ("ZIP", "1", "own/23", "[Content_Types].xml", "'wordprocessingml'"),
    ("ZIP", "2", "own/24", "mimetype", "'application/vnd.oasis.opendocument.text'"),
    ("OLE2", "3", "own/25", "CompObj", "'Word.Document.' ['6' '8']"),
]


def format_rows() -> list[tuple]:
    rows = []
    for k, (puid, name, version, mime, container, extensions, over, signatures) in enumerate(FORMATS):
        sigs = [(n, [], [(p, s, compile_sequence(s, p, o, m)) for p, s, o, m in patterns]) for n, patterns in signatures]
        rows.append((k, 0, puid, [mime] if mime else [], container, name, version, None, str(9000 + k), extensions, None, over, sigs, None))
    return rows


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(format_rows(), schema.FORMAT)


def generated(spark: SparkSession, n: int = 2000, seed: int = 1) -> DataFrame:
    """The own registry and n made formats, for measurements at the size of a public registry: of ten, six have a literal at the beginning, one a
    wide gap, one an alternative, one a pattern at the end, one a floating pattern."""
    rng = random.Random(seed)
    byte = lambda k: "".join(f"{rng.randrange(256):02X}" for _ in range(k))
    shapes = [
        *[lambda: [("BOF", byte(rng.randint(3, 10)), str(rng.choice((0, 0, 0, 4, 257))), "0")]] * 6,
        lambda: [("BOF", f"{byte(3)}{{36-1426}}{byte(3)}", "0", "0")], lambda: [("BOF", f"({byte(2)}|{byte(2)}){byte(3)}[01:7F]", "0", "0")], lambda: [("BOF", byte(2), "0", "0"), ("EOF", byte(4), "0", "64")], lambda: [("VAR", byte(6), "0", "0")],
    ]
    rows = format_rows()
    for k in range(n):
        patterns = shapes[k % 10]()
        rows.append((len(FORMATS) + k, 0, f"made/{k}", [], None, f"made {k}", "", None, str(20000 + k), [f"x{k}"], None, [], [("s", [], [(p, s, compile_sequence(s, p, o, m)) for p, s, o, m in patterns])], None))
    return spark.createDataFrame(rows, schema.FORMAT)


def containers(spark: SparkSession) -> DataFrame:
    rows = [(t, i, puid, path, compile_container_sequence(s), k) for k, (t, i, puid, path, s) in enumerate(CONTAINERS)]
    return spark.createDataFrame(rows, schema.CONTAINER)
