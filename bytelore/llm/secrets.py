"""Secret scan by one combined automaton (operator 1).

Method. Every rule is an expression over bytes. The reversed rules are compiled together by subset construction and
minimisation into one set of transition arrays; one backward pass over the bytes of a text then marks, for every rule,
each position where a string of that rule begins. Per rule, the leftmost mark is extended to its longest string by the
rule's own forward automaton, and the search goes on behind it: leftmost, longest, non-overlapping spans. Length
conditions follow; spans that fail them are dropped.

Kinds. `assign`, `access` and `hex` are the base kinds with fixed meaning; the others (tokens with a fixed prefix, signed
web tokens, private-key headers, credentials in URLs) add spans and never remove one.

Cases: null text is read as empty and gives no spans; rows are independent of each other, so repeated rows, ties and empty
tables need nothing special; a very long text takes time in proportion to its bytes and memory for the places where a rule begins; other
columns are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelore.llm.automaton import Automaton, Node, alt, at_least, chars, maybe, plus, seq, star, turned, word
from bytelore.llm.common import arrow_batch, mapped, table, text_column

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_WORD = chars(_UPPER + _LOWER + _DIGIT)
_VALUE = chars(_UPPER + _LOWER + _DIGIT + "+/_.=-")
_URLSAFE = chars(_UPPER + _LOWER + _DIGIT + "_-")
_BLANKS, _QUOTE = star(chars(" ")), maybe(chars("\"'"))

_BEFORE = seq(
    alt(word("password", True), word("passwd", True), word("secret", True), word("token", True), seq(word("api", True), maybe(chars("_")), word("key", True))),
    _QUOTE, _BLANKS, chars(":="), _BLANKS, _QUOTE,
)

#: Kinds in the order in which spans that begin together are listed, and the strings of each.
RULES: dict[str, Node] = {
    "assign": seq(_BEFORE, plus(_VALUE)),
    "access": seq(word("AKIA"), plus(chars(_UPPER + _DIGIT))),
    "hex": at_least(chars(_DIGIT + "abcdef"), 24),
    "hosting": seq(word("gh"), chars("pousr"), word("_"), plus(_WORD)),
    "chat": seq(word("xox"), chars("abprs"), word("-"), plus(chars(_UPPER + _LOWER + _DIGIT + "-"))),
    "payment": seq(chars("sr"), word("k_"), alt(word("live"), word("test")), word("_"), plus(_WORD)),
    "webkey": seq(word("AIza"), plus(_URLSAFE)),
    "signed": seq(word("eyJ"), plus(_URLSAFE), word(".eyJ"), plus(_URLSAFE), word("."), plus(_URLSAFE)),
    "pem": seq(word("-----BEGIN "), star(chars(_UPPER + " ")), word("PRIVATE KEY-----")),
    "urlauth": seq(word("://"), plus(chars(_UPPER + _LOWER + _DIGIT + "._~%-")), word(":"), plus(chars(_UPPER + _LOWER + _DIGIT + "._~%!$&*+=-")), word("@"), _WORD),
}
#: Least lengths in bytes. Only that of hex is part of the automaton (a run counter for each kind would multiply its states).
LEAST = {"access": 20, "hex": 24, "hosting": 34, "chat": 15, "payment": 24, "webkey": 39, "signed": 36}
BASE = ("assign", "access", "hex")
LEAST_VALUE = 6
Span = tuple[int, int, str]


class SecretScanner:
    def __init__(self, rules: dict[str, Node] = RULES):
        self.kinds = list(rules)
        self.begins = Automaton([turned(x) for x in rules.values()], anywhere=True)
        self.forward = [Automaton([x], anywhere=False) for x in rules.values()]
        self.before = Automaton([_BEFORE], anywhere=False)

    def spans(self, text: str) -> list[Span]:
        """(start, end, kind) in code points, by start, then kind as listed."""
        data = text.encode("utf-8", "surrogatepass")
        marks = self.begins.ends(data[::-1])
        if not marks:
            return []
        size, accepts = len(data), self.begins.accepts
        found: list[tuple[int, int, int]] = []
        done = [0] * len(self.kinds)
        for back, state in reversed(marks):
            start = size - back
            for k in accepts[state]:
                if start >= done[k]:
                    done[k] = end = self.forward[k].longest(data, start)
                    kind = self.kinds[k]
                    if end - start >= LEAST.get(kind, 0) and (kind != "assign" or end - self._value(data, start, end) >= LEAST_VALUE):
                        found.append((start, k, end))
        found.sort()
        if len(data) == len(text):
            return [(s, e, self.kinds[k]) for s, k, e in found]
        at = _code_points(data, {x for s, _, e in found for x in (s, e)})
        return [(at[s], at[e], self.kinds[k]) for s, k, e in found]

    def _value(self, data: bytes, start: int, end: int) -> int:
        """Where the value of an assignment begins: behind the name, one separator and one quote, if there is a value."""
        rows, first = self.before.rows, self.before.first_accepting
        state, best = self.before.start, start
        for i in range(start, end - 1):
            state = rows[state][data[i]]
            if state >= first:
                best = i + 1
            elif state == self.before.dead:
                break
        return best


def _code_points(data: bytes, offsets: set[int]) -> dict[int, int]:
    out, last, n = {}, 0, 0
    for x in sorted(offsets):
        n += len(data[last:x].decode("utf-8", "surrogatepass"))
        out[x], last = n, x
    return out


@lru_cache(maxsize=1)
def scanner() -> SecretScanner:
    return SecretScanner()


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span (overlapping ones as one) replaced by a mark of its first kind."""
    out, last = [], 0
    for start, end, kind in sorted(spans):
        if start >= last:
            out += [text[last:start], f"[{kind}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, start, end, secret): a row for each span."""

    def run(batches):
        own = scanner()
        for batch in batches:
            rows = [(i, k, s, e, t[s:e]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s, e, k in own.spans(t)]
            c = list(zip(*rows, strict=True)) or [()] * 5
            yield arrow_batch({id_col: (list(c[0]), pa.int64()), "kind": (list(c[1]), pa.string()), "start": (list(c[2]), pa.int64()), "end": (list(c[3]), pa.int64()), "secret": (list(c[4]), pa.string())})

    return mapped(df.select(F.col(id_col).cast("long").alias(id_col), text_column(text_col).alias("text")), run, f"{id_col} long, kind string, start long, end long, secret string")


def redact_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with secrets replaced by marks in `text_col`; null stays null."""

    at = df.columns.index(text_col)

    def run(batches):
        own = scanner()
        for batch in batches:
            texts = [t and redacted(t, own.spans(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(i).type) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return mapped(df, run, df.schema)


def secret_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts and digest of the base kinds, all spans as text."""

    def run(batches):
        own = scanner()
        for batch in batches:
            spans = [own.spans(t) for t in batch.column(1).to_pylist()]
            base = [[x for x in s if x[2] in BASE] for s in spans]
            counts = {f"n_{k}": ([sum(x[2] == k for x in b) for b in base], pa.int64()) for k in BASE}
            yield arrow_batch({id_col: (batch.column(0), pa.int64()), **counts, "base_sha256": ([hashlib.sha256(span_text(b).encode()).hexdigest() for b in base], pa.string()), "spans": ([span_text(s) for s in spans], pa.string())})

    return mapped(df.select(F.col(id_col).cast("long").alias(id_col), text_column(text_col).alias("text")), run, f"{id_col} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))
