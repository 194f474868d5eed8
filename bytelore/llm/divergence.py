"""Operator 13: how the sources of a language differ in their words, by bounds of term buckets and by postings.

Terms are runs of ASCII letters (A-Z lower-cased) and other non-ASCII characters. Each language keeps the V terms that at least
MIN_DOCUMENTS of its documents have. In a group (language, source), and in a language, a kept term of count c has
p = 1 + SCALE * (c + 1) div (N + V), where N sums the counts; f(p, q) = (p - q)^2 div q. All of it is whole-number arithmetic.

Term part (the TOP terms of a group by f against the language's q, where p > q): terms of a group are put in buckets by their
count and by the binary digits of their count in the language. A bucket has one p, and f grows as q shrinks, so its least q
bounds it. The buckets of best bounds are evaluated first, until they hold TOP terms; the least value of the best TOP of these
bounds the TOP-th from below, and the second wave evaluates every other bucket whose bound is not strictly below it. What is
left unseen can't be among the TOP, ties included.

Pair part (for every other source of the language, f summed over all V terms): terms that neither group has add one constant;
terms of one group alone add sums over its counts (histograms, not terms); only terms that both have are met one by one, in a
join of postings, each unordered pair of sources once.

Null text, language or source: ''. Repeated rows are documents of their own. A text of any length is split in pieces of
PIECE bytes. Ties: by term or source, as UTF-8. Other columns are not looked at, whatever their names. The result has a row for each pair
of sources of a language, as its contract asks for; nothing else is made of pairs, but postings that share a term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytelore.llm.common import mapped, spark_schema, stored, table, text_column

MIN_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP = 200
PIECE = 1 << 22
#: Different terms of groups that a task counts before it hands them on.
HELD_TERMS = 400_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _runs(text: bytes) -> Counter:
    """Terms of a text and how often they stand there."""
    text = text if len(text) <= PIECE else memoryview(text)
    if isinstance(text, bytes):
        return Counter(text.translate(_LOWER).split())
    found, carried = Counter(), b""
    for at in range(0, len(text), PIECE):
        piece = carried + bytes(text[at : at + PIECE]).translate(_LOWER)
        whole, space, carried = piece.rpartition(b" ")
        found.update(whole.split())
    found.update(carried.split())
    return found


_COUNTED = {"lang": "string", "source": "string", "term": "string", "n": "bigint", "docs": "bigint"}


def _count(batches) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in counts.items():
            there, size = docs[lang, source], len(terms)
            columns = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(terms.keys(), pa.binary()).cast(pa.string()), pa.array(terms.values(), pa.int64()), pa.array([there[t] for t in terms], pa.int64())]
            yield from pa.Table.from_arrays(columns, names=list(_COUNTED)).to_batches(max_chunksize=20_000)
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = _runs(text)
            if (lang, source) not in counts:
                counts[lang, source], docs[lang, source] = Counter(), Counter()
            counts[lang, source].update(found)
            docs[lang, source].update(found.keys())
        if sum(map(len, counts.values())) > HELD_TERMS:
            yield from handed()
    yield from handed()


def _p(count: str, total: str, terms: str) -> Column:
    wide = "cast({} as decimal(38,0))".format
    return F.expr(f"1 + (({wide(count)} + 1) * {SCALE}) div ({wide(total)} + {terms})")


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _best(partition: list[str], *order: Column):
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank); see the module."""
    read = docs.select(text_column(lang).alias("lang"), text_column(source).alias("source"), text_column(text).alias("text"))
    counted = mapped(read.withColumn("text", F.col("text").cast("binary")), _count, spark_schema(*_COUNTED.items()))
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counted = counted.withColumns({"of_lang": F.sum("n").over(of_term), "docs": F.sum("docs").over(of_term), "leads": F.col("source") == F.min("source").over(of_term)})
    kept = stored(counted.where(F.col("docs") >= MIN_DOCUMENTS).drop("docs"))

    langs = kept.groupBy("lang").agg(F.count_if("leads").alias("terms"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = read.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = stored(groups.select("lang", "source", zero("terms"), zero("lang_total"), zero("total"), zero("own")))
    return _terms(kept, groups).unionByName(_pairs(kept, groups))


def _terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    key = ["lang", "source"]
    valued = kept.join(groups, key).select(*key, "term", "n", F.length(F.bin("of_lang")).alias("digits"), _p("n", "total", "terms").alias("p"), _p("of_lang", "lang_total", "terms").alias("q"))
    over = valued.where("p > q")
    bucket = [*key, "n", "digits"]
    buckets = over.groupBy(*bucket).agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count("*").alias("size")).withColumn("bound", F.expr(_f("p", "q")))
    before = Window.partitionBy(*key).orderBy(F.desc("bound"), "n", "digits").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*bucket, "bound", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    placed = stored(over.join(buckets, bucket).select(*key, "term", "p", "q", "bound", "before"))

    value = F.expr(_f("p", "q"))
    first = placed.where(F.col("before") < TOP).withColumn("value", value)
    first = first.withColumn("at", _best(key, F.desc("value"))).where(F.col("at") <= TOP)
    least = first.groupBy(*key).agg(F.max("at").alias("seen"), F.min("value").alias("kth")).where(F.col("seen") == TOP).select(*key, "kth")
    rest = placed.join(least, key, "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
    ranked = rest.withColumn("value", value).withColumn("rank", _best(key, F.desc("value"), F.asc("term"))).where(F.col("rank") <= TOP)
    return ranked.select(*key, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    key = ["lang", "source"]
    sized = groups.withColumn("none", F.when(F.col("terms") > 0, _p("0", "total", "greatest(terms, 1)")).otherwise(F.lit(1)))
    valued = kept.join(sized, key).select("lang", "source", "term", "n", _p("n", "total", "terms").alias("p"), "none")
    counts = valued.groupBy(*key, "p").agg(F.count("*").alias("size"))

    one = sized.select("lang", "source", "none", "own", "terms")
    other = sized.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"), F.col("own").alias("item_own"))
    pairs = one.join(other, "lang").where("source != item")  # the rows of the result
    of_own = counts.join(other, "lang").where("source != item").groupBy(*key, "item").agg(F.sum(F.expr("size * (" + _f("p", "item_none") + ")")).alias("own_sum"))
    of_other = counts.select("lang", F.col("source").alias("item"), "p", "size").join(one, "lang").where("source != item")
    of_other = of_other.groupBy(*key, "item").agg(F.sum(F.expr("size * (" + _f("none", "p") + ")")).alias("item_sum"))

    here = valued.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("none").alias("za"))
    there = valued.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("none").alias("zb"))
    more = lambda p, zp, q, zq: F.sum(F.expr(f"{_f(p, q)} - {_f(p, zq)} - {_f(zp, q)} + {_f(zp, zq)}"))
    both = here.join(there, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.count("*").alias("both"), more("pa", "za", "pb", "zb").alias("ab"), more("pb", "zb", "pa", "za").alias("ba"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("more")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("more"))))
    both = both.select("lang", ways.alias("way")).select("lang", "way.*")

    whole = pairs
    for part in (of_own, of_other, both):
        whole = whole.join(part, ["lang", "source", "item"], "left")
    whole = whole.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("own_sum", "item_sum", "more")})
    value = F.expr(f"if(terms = 0, 0, own_sum + item_sum + more + (terms - own - item_own) * ({_f('none', 'item_none')}))")
    summed = whole.select(*key, "item", value.alias("value"))
    return summed.withColumn("rank", _best(key, F.desc("value"), F.asc("item"))).select(*key, F.lit("pair").alias("part"), "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and sources that set the sources of each language apart; see the module."""
    return divergence(table(spark, sf_dir, "documents"))


_TABLE = "abcdefghijklmnopqrstuvwxyz"
#: The same without bounds, postings or histograms: every kept term of every group, every pair over all kept terms.
ORACLE = {
    "op13_divergence": f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
said AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, '{_TABLE.upper()}', '{_TABLE}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM said GROUP BY ALL HAVING count(DISTINCT d) >= {MIN_DOCUMENTS}),
langs AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS terms FROM kept GROUP BY ALL),
q AS (SELECT kept.lang, term, 1 + ({SCALE}::HUGEINT * (n + 1)) // (total + terms) AS q FROM kept JOIN langs USING (lang)),
groups AS (SELECT DISTINCT lang, source FROM docs),
own AS (SELECT lang, source, term, count(*) AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM own GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(o.n, 0) + 1)) // (coalesce(s.total, 0) + l.terms) AS p
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM dense JOIN q USING (lang, term) WHERE n > 0 AND p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {TOP}),
met AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM terms UNION ALL BY NAME FROM pairs)
"""
}
