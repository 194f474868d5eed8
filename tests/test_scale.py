"""What keeps tasks small when tables grow."""

from pyspark.sql import functions as F

from bytelore.functions import batches
from bytelore.operators import matching
from bytelore.plans import catalog, registry_queries
from bytelore.sources import records, registries, single


def test_python_code_gets_small_batches(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(0, 1200, 1, 1)
    out = batches.mapped(rows, lambda found: (seen.add(1) or b for b in found), "id long")
    assert out.count() == 1200 and seen.value == 3
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    try:
        for found in (catalog.queries()["gap_range_match"], registry_queries.queries()["compound_streams"]):
            spark.conf.set(key, "10000")
            monkeypatch.setattr(matching, "objects", lambda *a, **k: 1 / 0)
            try:
                found(spark, "/no/such/folder")
            except Exception:
                pass
            assert spark.conf.get(key) == str(batches.BATCH_ROWS)
    finally:
        spark.conf.set(key, before)


def test_records_are_parsed_once(spark):
    read = spark.sparkContext.accumulator(0)
    xml = f'<R xmlns="{records.NAMESPACE[1:-1]}"><report_format_detail><FileFormat><FileFormatIdentifier><Identifier>p/1</Identifier><IdentifierType>PUID</IdentifierType></FileFormatIdentifier></FileFormat></report_format_detail></R>'

    def given(found):
        for b in found:
            read.add(b.num_rows)
            yield b

    rows = spark.range(0, 6, 1, 1).select(F.col("id").cast("int").alias("ord"), F.lit(xml).alias("xml")).mapInArrow(given, "ord int, xml string")
    assert records.compiled_texts(rows).count() == 6 and read.value == 6


def test_ranges_of_a_zip_are_bounded_in_number(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x.zip")
    single.write_zip(spark.range(0, 95, 1, 4).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("name"), F.encode(F.repeat(F.lit("y"), F.col("id").cast("int")), "UTF-8").alias("content")), path)
    monkeypatch.setattr(single, "PARTITIONS", 4)
    monkeypatch.setattr(single, "BATCH_MEMBERS", 9)
    reader = single.ZipReader(path, 10)
    parts = reader.partitions()
    assert len(parts) <= 4
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["ord"], r["name"], r["size"], r["content"]) for r in rows] == [(k, f"m{k}", k, b"y" * k) for k in range(95)]


def test_one_registry_file_is_read_by_many_tasks(spark, tmp_path):
    one = lambda k: f"<format>\n <puid>p/{k}</puid><name> a &lt;/format&gt; {k} </name>\n</format>"
    body = [one(k) for k in range(200)]
    plain, noted = tmp_path / "plain.xml", tmp_path / "noted.xml"
    plain.write_text('<?xml version="1.0" encoding="UTF-8"?>\n<formats version="1">\n' + "\n".join(body) + "\n</formats>\n")
    noted.write_text("<formats>" + "".join(body[:100]) + f"<!-- {one(500)} -->" + "".join(body[100:]) + "</formats>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        assert registries._elements(spark, str(plain)).rdd.getNumPartitions() > 4
        for path in (plain, noted):
            rows = registries.read_formats(spark, str(path)).orderBy("ord").collect()
            assert [(r.ord, r.puid, r.name) for r in rows] == [(k, f"p/{k}", f" a </format> {k} ") for k in range(200)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
