"""Operator 13 against its SQL and against a plain version."""

import re
from collections import Counter

import duckdb
import pytest

from bytelore.llm import divergence as module
from bytelore.llm.divergence import ORACLE, TOP, divergence, op13_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs):
    docs = [tuple(x or "" for x in d) for d in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [(source, Counter(TERM.findall(text.translate(LOWER)))) for other, source, text in docs if other == lang]
        kept = sorted(t for t, n in Counter(t for _, c in own for t in c).items() if n >= 3)

        def shares(counts):
            total = sum(counts[t] for t in kept)  # noqa: B023
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}  # noqa: B023

        of = {source: sum((c for s, c in own if s == source), Counter()) for source in {s for s, _ in own}}
        q, p = shares(sum((c for _, c in own), Counter())), {source: shares(c) for source, c in of.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for source, counts in of.items():
            found = {"term": {t: f(p[source][t], q[t]) for t in kept if counts[t] and p[source][t] > q[t]}, "pair": {other: sum(f(p[source][t], p[other][t]) for t in kept) for other in of if other != source}}
            for part, items in found.items():
                ranked = sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked) if part == "pair" or k < TOP]
    return sorted(out)


def rows(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


DOCS = (
    [("en", "a", "The cat; the CAT, the Ärger ärger x1y")] * 3
    + [("en", "b", "the dog saw the cat"), ("en", "b", None), ("en", None, "dog dog dog the"), ("en", "c", "")]
    + [(None, "a", "no term thrice"), (None, "b", "here")]
    + [("de", s, f"wort{chr(97 + k % 26)}{chr(97 + k // 26)} immer und immer") for k in range(700) for s in ("x", "y", "x")[: 1 + k % 3]]
    + [("de", "y", f"wort{chr(97 + k % 26)}{chr(97 + k // 26)} " * (k % 5)) for k in range(600)]
    + [("fr", "eins", "l'été à Paris"), ("fr", "eins", "été"), ("fr", "eins", "un ÉTÉ été")]
)


def test_small_documents_equal_the_plain_version(spark):
    df = spark.createDataFrame(DOCS, "lang string, source string, text string").repartition(5)
    assert rows(divergence(df)) == plain(DOCS)


def test_ties_at_the_last_rank(spark):
    words = [a + b for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    docs = [("en", "a", " ".join(words[:300]))] * 3 + [("en", "b", " ".join(words[300:]))] * 3 + [("en", "c", "aa")] * 30
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    assert rows(divergence(df)) == plain(docs)


def test_long_texts_are_split_between_terms(spark, monkeypatch):
    text = "word other, " * 1000 + "ünd" * 40
    for piece in (7, 64, 1 << 22):
        monkeypatch.setattr(module, "PIECE", piece)
        assert module._runs(text.encode()) == {k.encode(): n for k, n in Counter(TERM.findall(text)).items()}
    monkeypatch.undo()
    docs = [("en", "a", "long words of a text " * 300_000), ("en", "b", "long words"), ("en", "b", "long text of words")]
    assert rows(divergence(spark.createDataFrame(docs, "lang string, source string, text string"))) == plain(docs)


def test_empty_tables_and_other_columns(spark):
    schema = "lang string, source string, text string, term long, n string, p int, part int, `rank` int"
    assert rows(divergence(spark.createDataFrame([], schema))) == []
    docs = [("en", "a", "one two one"), ("en", "b", "one two"), ("en", "b", "two one")]
    assert rows(divergence(spark.createDataFrame([(*d, 1, "x", 2, 3, 4) for d in docs], schema))) == plain(docs)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    assert rows(op13_divergence(spark, f"/root/testdata/{sf}")) == sorted(con.execute(f"SELECT lang, source, part, item, value, rank FROM ({ORACLE['op13_divergence']})").fetchall())
