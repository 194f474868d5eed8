"""URL filter by the ratio of two character language models (operator 4).

Method. Rules on hosts and paths decide some URLs; these are the labelled set. Two variable-order Markov models over
folded characters (orders 0 to 2, each order smoothed with the one below by Witten and Bell's weights) are counted over
the labelled URLs that are not held out, one for accepted and one for rejected ones. A URL that no rule fits gets the mean
per character of the difference of its log-likelihoods; it is allowed from a threshold on that is calibrated over the
labelled URLs that are held out, a quarter by a hash of the URL: the lowest hundredth with the best sum of the rates of
allowed and blocked URLs that it separates, or rather the middle between it and the hundredth below that has URLs. Differences are kept as whole numbers, in SCALE-ths, so sums are the same in
whatever order they are made.

The folded alphabet has 40 symbols, so the table of differences has at most 40^3 rows: that bound is what allows its
broadcast. Counts are pre-aggregated in each task, so a host with a third of all rows is no larger group than any other.

Cases: a null URL or one without `://` has empty host and path, fits no rule and is judged by the model (from its end
symbol alone if empty); with no labelled URL of one kind all differences are by the smoothing alone; repeated rows and
repeated page ids are judged row by row; a very long URL is judged by all of its characters; other columns are ignored. Only built-in functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelore.llm.common import forget, stored, table

#: Fixed values: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Symbols 1 to 37; every digit is folded to 0; any other character is 38; the start is 0 and the end 39.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-?=&#_%:"
OTHER, END, SIZE = 38, 39, 40
SCALE = 1 << 20
#: First digits of the hashes of URLs that are held out.
HELD_OUT = ("0", "4", "8", "c")


def url_parts(url: str = "url") -> tuple[F.Column, F.Column]:
    at = F.instr(F.col(url), "://")
    after = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), upper, lower), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def rule_columns(rules=RULES) -> tuple[F.Column, F.Column]:
    """Rule text and verdict of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def grams(url: str = "url") -> F.Column:
    """Array of codes (two symbols before, symbol) of every symbol of a URL and its end."""
    folded = F.regexp_replace(F.lower(F.coalesce(F.col(url), F.lit(""))), "[0-9]", "0")
    symbols = F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c)).otherwise(OTHER))
    padded = F.concat(F.array(F.lit(0), F.lit(0)), symbols, F.array(F.lit(END)))
    coded = lambda s: F.transform(F.slice(s, 3, F.size(s)), lambda c, i: F.get(s, i) * SIZE * SIZE + F.get(s, i + 1) * SIZE + c)
    return F.get(F.transform(F.array(padded), coded), F.lit(0))  # one array of symbols for all positions


def ratio_table(labelled: DataFrame) -> DataFrame:
    """(g, d): difference of the log-probabilities of the last symbol of g under the two models; at most 40^3 rows."""
    counts = stored(labelled.select("verdict", F.explode("_grams").alias("g")).groupBy("verdict", "g").agg(F.count("*").cast("double").alias("n")))
    split = {"x": F.expr(f"g div {SIZE * SIZE}"), "b": F.expr(f"(g div {SIZE}) % {SIZE}"), "c": F.col("g") % SIZE}
    seen = counts.withColumns(split)
    pairs = seen.groupBy("verdict", "b", "c").agg(F.sum("n").alias("n_bc"))
    sums = [  # all bounded by the alphabet
        (seen.groupBy("verdict", "x", "b").agg(F.sum("n").alias("n_xb"), F.count("*").cast("double").alias("t_xb")), ["verdict", "x", "b"]),
        (pairs, ["verdict", "b", "c"]),
        (pairs.groupBy("verdict", "b").agg(F.sum("n_bc").alias("n_b"), F.count("*").cast("double").alias("t_b")), ["verdict", "b"]),
        (pairs.groupBy("verdict", "c").agg(F.sum("n_bc").alias("n_c")), ["verdict", "c"]),
        (pairs.groupBy("verdict").agg(F.sum("n_bc").alias("n_all")), ["verdict"]),
    ]
    codes = labelled.sparkSession.range(SIZE**3).select(F.col("id").cast("int").alias("g"), F.explode(F.array(F.lit("allow"), F.lit("block"))).alias("verdict"))
    full = codes.join(F.broadcast(counts), ["verdict", "g"], "left").withColumns(split)
    for part, keys in sums:
        full = full.join(F.broadcast(part), keys, "left")
    full = full.fillna(0.0)
    p1 = (F.col("n_c") + 1) / (F.col("n_all") + SIZE)
    full = full.withColumn("p1", p1)
    full = full.withColumn("p2", F.when(F.col("n_b") > 0, (F.col("n_bc") + F.col("t_b") * F.col("p1")) / (F.col("n_b") + F.col("t_b"))).otherwise(F.col("p1")))
    full = full.withColumn("p3", F.when(F.col("n_xb") > 0, (F.col("n") + F.col("t_xb") * F.col("p2")) / (F.col("n_xb") + F.col("t_xb"))).otherwise(F.col("p2")))
    difference = F.sum(F.when(F.col("verdict") == "allow", F.ln("p3")).otherwise(-F.ln("p3")))
    return full.groupBy("g").agg(F.round(difference * SCALE).cast("long").alias("d"))


def held_out(url: str = "url") -> F.Column:
    return F.substring(F.md5(F.coalesce(F.col(url), F.lit(""))), 1, 1).isin(*HELD_OUT)


def _bin() -> F.Column:
    """Score in hundredths."""
    return F.floor(F.col("sum") * 100.0 / (F.col("count") * float(SCALE)))


def threshold(scored: DataFrame) -> float:
    """The calibrated threshold in hundredths; the histogram has a bounded number of bins, as differences are bounded."""
    bins = scored.where("verdict IS NOT NULL AND _held").groupBy(_bin().alias("bin")).agg(F.sum(F.when(F.col("verdict") == "allow", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("b")).orderBy("bin").collect()
    allowed, blocked = sum(r.a for r in bins), sum(r.b for r in bins)
    if not allowed or not blocked:
        return 0.0
    best, at, below_a, below_b, below = -1, 0, 0, 0, bins[0].bin
    for r in bins:  # everything from this bin on is allowed
        gain = (allowed - below_a) * blocked + below_b * allowed
        if gain > best:
            best, at = gain, math.ceil((below + r.bin) / 2)
        below = r.bin
        below_a, below_b = below_a + r.a, below_b + r.b
    return float(at)


def judged(pages: DataFrame, rules=RULES, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score, by_model, _held): by_model is what the method alone says."""
    host, path = url_parts(url)
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url).cast("string").alias(url)).withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    rule, verdict = rule_columns(rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict, "_row": F.monotonically_increasing_id(), "_held": held_out(url), "_grams": grams(url)})
    model = stored(ratio_table(rows.where("verdict IS NOT NULL AND NOT _held")))
    keys = ["_row", id_col, "host", "path", "rule", "verdict", "_held"]
    scored = stored(rows.select(*keys, F.explode("_grams").alias("g")).join(F.broadcast(model), "g").groupBy(*keys).agg(F.sum("d").alias("sum"), F.count("*").alias("count")))
    forget(model)
    by_model = F.when(_bin() >= threshold(scored), "allow").otherwise("block")
    score = F.col("sum") / (F.col("count") * float(SCALE))
    return scored.select(id_col, "host", "path", "rule", F.coalesce("verdict", by_model).alias("verdict"), score.alias("score"), by_model.alias("by_model"), "_held")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in cases) + " END"
    kind = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{k}'" for k, h, p in cases) + " END"
    return f"""
WITH after AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS t FROM pages),
split AS (SELECT page_id, url, translate(regexp_extract(t, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM after),
ruled AS (SELECT row_number() OVER () AS r, page_id, url, host, path, {rule} AS rule, {kind} AS verdict, substr(md5(coalesce(url, '')), 1, 1) IN ({', '.join(f"'{x}'" for x in HELD_OUT)}) AS held FROM split),
symbols AS (SELECT r, verdict, held, list_concat([0, 0], list_transform(list_filter(string_split(regexp_replace(lower(coalesce(url, '')), '[0-9]', '0', 'g'), ''), lambda c: c <> ''), lambda c: CASE WHEN instr('{ALPHABET}', c) > 0 THEN instr('{ALPHABET}', c) ELSE {OTHER} END), [{END}]) AS s FROM ruled),
grams AS (SELECT r, verdict, held, unnest(list_transform(range(3, len(s) + 1), lambda i: s[i - 2] * 1600 + s[i - 1] * 40 + s[i])) AS g FROM symbols),
counts AS (SELECT verdict, g, count(*)::DOUBLE AS n FROM grams WHERE verdict IS NOT NULL AND NOT held GROUP BY ALL),
full_table AS (SELECT v.verdict, q.g, coalesce(n, 0) AS n, q.g // 1600 AS x, (q.g // 40) % 40 AS b, q.g % 40 AS c FROM range({SIZE**3}) q(g) CROSS JOIN (VALUES ('allow'), ('block')) v(verdict) LEFT JOIN counts USING (verdict, g)),
sums AS (SELECT *, sum(n) OVER (PARTITION BY verdict, c) AS n_c, sum(n) OVER (PARTITION BY verdict) AS n_all, sum(n) OVER (PARTITION BY verdict, b, c) AS n_bc, sum(n) OVER (PARTITION BY verdict, b) AS n_b, sum(n) OVER (PARTITION BY verdict, x, b) AS n_xb, sum(sign(n)) OVER (PARTITION BY verdict, x, b) AS t_xb FROM full_table),
kinds AS (SELECT *, sum(CASE WHEN x = 0 AND n_bc > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY verdict, b)::DOUBLE AS t_b, (n_c + 1) / (n_all + {SIZE}) AS p1 FROM sums),
second AS (SELECT *, CASE WHEN n_b > 0 THEN (n_bc + t_b * p1) / (n_b + t_b) ELSE p1 END AS p2 FROM kinds),
third AS (SELECT g, verdict, CASE WHEN n_xb > 0 THEN (n + t_xb * p2) / (n_xb + t_xb) ELSE p2 END AS p3 FROM second),
ratio AS (SELECT g, round(sum(CASE WHEN verdict = 'allow' THEN ln(p3) ELSE -ln(p3) END) * {SCALE})::BIGINT AS d FROM third GROUP BY g),
scored AS (SELECT r, floor(sum(d) * 100.0::DOUBLE / (count(*) * {SCALE}::DOUBLE)) AS bin FROM grams JOIN ratio USING (g) GROUP BY r),
labelled AS (SELECT bin, count(*) FILTER (WHERE verdict = 'allow') AS a, count(*) FILTER (WHERE verdict = 'block') AS b FROM scored JOIN ruled USING (r) WHERE verdict IS NOT NULL AND held GROUP BY bin),
gains AS (SELECT bin, ceil((coalesce(lag(bin) OVER (ORDER BY bin), bin) + bin) / 2.0) AS middle, (sum(a) OVER () - coalesce(sum(a) OVER w, 0)) * sum(b) OVER () + coalesce(sum(b) OVER w, 0) * sum(a) OVER () AS gain, sum(a) OVER () * sum(b) OVER () AS both_kinds FROM labelled WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT coalesce((SELECT middle FROM gains WHERE both_kinds > 0 ORDER BY gain DESC, bin LIMIT 1), 0) AS bin)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN scored.bin >= cut.bin THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled JOIN scored USING (r) CROSS JOIN cut"""


ORACLE = {"op4_urls": _oracle()}
