"""Every query of the catalog against its SQL, on small made tables."""

import duckdb
import pytest

from bytelore.plans import catalog, registry_queries

QUERIES, SQL = catalog.queries() | registry_queries.queries(), catalog.oracle_sql() | registry_queries.oracle_sql()
NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    texts = ["alpha ninth than then", "b\nAll rights reserved.", "x" * 1500 + " non tth", "", "naïve “text” with ünïcode", "thin 61?b a.b"]
    spark.createDataFrame([(i, texts[i % 6] + str(i), f"src{i % 3}") for i in range(310)], "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, f"https://h/{i}" + (".html" if i % 3 else ""), ("<!DOCTYPE html>" if i % 2 else "") + f"<p>{i}" + ("</body></html>" if i % 5 else "")) for i in range(30)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(i, f"part {i}", f"TYPE {i % 7}", i % 9) for i in range(1, 60)], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(i, f"NATION {'X' * i}") for i in range(25)], "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(i, texts[i % 6].replace("\n", " ") + str(i)) for i in range(20)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages", "part", "nation", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return folder, con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, tables, name):
    folder, con = tables
    got = QUERIES[name](spark, folder)
    rel = con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))
