"""Personal data by candidate generators and boosted trees (operator 2).

Method. The base kinds (email, ip, card, phone) have fixed patterns and conditions and always stay. Beside them,
generators of high recall propose spans that may overlap: every run of up to GROUPS neighbouring groups of digits, and every
written-out mail address, account number and address of six groups. Boosted trees score each candidate by its format
(digits, groups, separators, check sums) and its context (words before and behind it, what touches it, groups beside it), so
they also decide which of several overlapping spans is the right one. A candidate is selected if its score reaches the
threshold of its kind and it overlaps neither a base span nor a selected one with a better score.

The trees are trained here on seeded invented examples, so the model needs no data and is the same everywhere. Thresholds
are calibrated for PRECISION on examples of other formats in other surroundings (PHRASES and SHAPES keep the three sets
apart); a third set, used for nothing else, gives the precision and recall in the README and the tests.

Cases: null text is read as empty and has no spans; rows are independent, so repeated rows, ties and empty tables need
nothing special; runs of thousands of digits or groups are no candidates as a whole, and a very long text gives candidates
in proportion to its length; other columns are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelore.llm.boosting import BoostedTrees
from bytelore.llm.common import arrow_batch, mapped, table, text_column

Span = tuple[int, int, str]
BASE = ("email", "ip", "card", "phone")
ADDED = ("digits", "mail", "iban", "hardware")
PRECISION = 0.98

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Groups of digits in a candidate, and digits in all of them.
GROUPS, FEWEST, MOST = 5, 7, 16
_GROUP = re.compile("[0-9]++")
_BETWEEN = re.compile(r"[\x20./()-]{1,3}")
_MAIL = re.compile(r"[A-Za-z0-9._-]{1,64}\x20?(?:[\[(]at[\])]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}")
_MAIL_PART = re.compile(r"(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_HARDWARE = re.compile(r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Za-z:-])")

#: Words that tell what a number is, before and behind it.
_HINTS = {
    "call": re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|teléfono|téléphone|handy|cell|number is)\b"),
    "number": re.compile(r"(?i)\b(?:ssn|social|passport|tax|sozialversicherung|dni|nss|identity|insured)\b"),
    "money": re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b"),
    "mail": re.compile(r"(?i)\b(?:mail|e-mail|contact|write|reach|correo|courriel)\b"),
    "other": re.compile(r"(?i)\b(?:order|invoice|version|isbn|item|page|pages|year|price|total|ref|sku|build|section|score|http|www|part|lot|model|serial|figure|table|since|from|until)\b"),
}
_BEHIND = re.compile(r"(?i)\s?(?:%|€|\$|eur|usd|kg|km|cm|mm|mb|gb|pages|items|units|people|years|times|am\b|pm\b)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The base kinds: leftmost, non-overlapping per kind; matches that fail their condition are dropped."""
    found: list[tuple[int, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, 0, done))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return [(s, e, BASE[k]) for s, k, e in found]


class Candidate(NamedTuple):
    start: int
    end: int
    kind: str
    before: int  # digits of the group right before it, 0 if none
    behind: int


def _digit_runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """(start, end) of groups of digits with nothing but separators between them."""
    run: list[tuple[int, int]] = []
    for m in _GROUP.finditer(text):
        if run and not _BETWEEN.fullmatch(text, run[-1][1], m.start()):
            yield run
            run = []
        run.append(m.span())
    if run:
        yield run


def candidates(text: str) -> list[Candidate]:
    found = []
    for run in _digit_runs(text):
        for i, (start, _) in enumerate(run):
            digits = 0
            for j in range(i, min(i + GROUPS, len(run))):
                digits += run[j][1] - run[j][0]
                if digits > MOST:
                    break
                if digits >= FEWEST:
                    size = lambda k: min(99, run[k][1] - run[k][0])  # noqa: E731, B023
                    begin = start - 1 if start and text[start - 1] in "(+" else start
                    found.append(Candidate(begin, run[j][1], "digits", size(i - 1) if i else 0, size(j + 1) if j + 1 < len(run) else 0))
    if "dot" in text or "at)" in text or "at]" in text or " at " in text:
        for m in _MAIL.finditer(text):
            end, marked = m.end(), "[at]" in m[0] or "(at)" in m[0]
            for _ in range(4):
                part = _MAIL_PART.match(text, end)
                if not part or (part[0][0] == "." and not marked):
                    break
                end = part.end()
                found.append(Candidate(m.start(), end, "mail", 0, 4 * bool(_MAIL_PART.match(text, end))))
    found += [Candidate(*m.span(), "iban", 0, 0) for m in _IBAN.finditer(text)]
    if ":" in text or "-" in text:
        found += [Candidate(*m.span(), "hardware", 0, 0) for m in _HARDWARE.finditer(text)]
    return found


def _iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _date(groups: list[str]) -> bool:
    year = [1900 <= int(g) <= 2100 for g in groups if len(g) == 4]
    return len(groups) == 3 and any(year) and sorted(map(len, groups))[1] <= 2 or len(groups) == 1 and len(groups[0]) == 8 and 1900 <= int(groups[0][:4]) <= 2100 and int(groups[0][4:6]) <= 12


_DATE_BEFORE = re.compile(r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}(?: [0-9]{2}:[0-9]{2})?|(?:19|20)[0-9]{6})[\x20,;]{1,2}\(?\Z")
_LETTER = re.compile(r"[^\W\d_]")
_NO_HINTS = (0.0,) * (2 * len(_HINTS))
_AFTER = [_HINTS[k] for k in ("call", "number", "other")]
_NO_AFTER = (0.0,) * len(_AFTER)


def _hints(before: str) -> tuple[float, ...]:
    """Which words stand in the context before a candidate, and which of them close to it."""
    if not _LETTER.search(before):
        return _NO_HINTS
    close = before[-16:]
    return (*(float(bool(h.search(before))) for h in _HINTS.values()), *(float(bool(h.search(close))) for h in _HINTS.values()))


def _after(behind: str) -> tuple[float, ...]:
    return tuple(float(bool(h.search(behind))) for h in _AFTER)


def features(text: str, c: Candidate, hints: tuple[float, ...] | None = None) -> list[float]:
    own, before, behind = text[c.start : c.end], text[max(0, c.start - 30) : c.start], text[c.end : c.end + 20]
    groups = _GROUP.findall(own)
    digits, sizes = "".join(groups), [len(g) for g in groups]
    separators = (" " in own) + ("." in own) + ("/" in own) + ("-" in own)
    touch = lambda x: float(x.isalnum() or x in "_/=&#%$€:")
    return [
        float(ADDED.index(c.kind)), len(own), len(digits), len(groups), sizes[0] if sizes else 0, sizes[-1] if sizes else 0, float(max(sizes, default=0)), float(min(sizes, default=0)), c.before, c.behind,
        own.count("-"), own.count("."), own.count(" "), own.count("/"), float("(" in own and ")" in own), float("(" in own) - float(")" in own), float(own[:1] == "+"), float(digits[:1] == "0"), separators, float(sizes == [3, 2, 4]), float(sizes == [3, 3, 4]),
        float(_date(groups)), float(c.kind == "iban" and _iban_ok(own)), float(luhn(digits) if len(digits) > 11 else 0), float("at" in own and ("[" in own or "(" in own)), float(" at " in own), float("[dot]" in own or "(dot)" in own), float(" dot " in own),
        touch(before[-1]) if before else 0.0, touch(behind[0]) if behind else 0.0, float(behind[:2] in (".0", ",0") or behind[:1] in ".," and behind[1:2].isdigit()), float(before[-1:] in (".", ",", "-", "/")), float(bool(_BEHIND.match(behind))),
        float(bool(_DATE_BEFORE.search(before))), *(_hints(before) if hints is None else hints), *(_after(behind) if _LETTER.search(behind) else _NO_AFTER),
    ]


def scored_candidates(text: str, taken: _Taken) -> Iterator[tuple[Candidate, list[float]]]:
    """Candidates that overlap no taken span, with their features. What stands before a list of numbers is the context of all of them."""
    start, hints, listed, end, any_taken = -1, _NO_HINTS, _NO_HINTS, -9, bool(taken.starts)
    for c in candidates(text):
        if not any_taken or taken.free((c.start, c.end, c.kind)):
            if c.start != start:
                start, hints = c.start, _hints(text[max(0, c.start - 30) : c.start])
                if c.kind == "digits" and c.start <= end + 3 and hints == _NO_HINTS:
                    hints = listed
                listed = hints
            end = max(end, c.end) if c.kind == "digits" else end
            yield c, features(text, c, hints)


def _n(rng: random.Random, k: int) -> str:
    return rng.choice("123456789") + "".join(rng.choice("0123456789") for _ in range(k - 1))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))


def _iban(rng: random.Random, countries: tuple[str, ...]) -> str:
    rest = rng.choice(countries) + "00" + _n(rng, 18)
    number = int("".join(str(int(c, 36)) for c in rest[4:] + rest[:4]))
    s = f"{rest[:2]}{98 - number % 97:02d}{rest[4:]}"
    return s if rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))


#: Words before a number that is personal, and before one that is not: of training, of calibration, of the test.
PHRASES = (
    (("tel ", "phone: ", "call ", "Telefon ", "mobile ", "my phone is ", "ssn ", "social ", "DNI ", "fax "), ("order ", "invoice ", "item ", "ref ", "build ", "sku ", "page ", "total ", "since ", "version ", "part ")),
    (("Handy: ", "téléphone ", "please call us on ", "number is ", "social security ", "insured as ", "fax: ", "cell "), ("lot ", "model ", "serial ", "from ", "ISBN ", "year ", "section ", "score ", "order no. ", "version: ")),
    (("teléfono ", "fax no ", "or call ", "phone ", "SSN: ", "passport ", "identity "), ("figure ", "table ", "until ", "price ", "http ", "invoice no ", "order nr. ", "serial no. ")),
)


def _number(rng: random.Random, which: int) -> str:
    """A number that words decide on, in a form of a set: each form, digits aside, is of one set alone."""
    while True:
        sizes = [rng.randint(2, 4) for _ in range(rng.randint(2, 4))]
        if not 8 <= sum(sizes) <= 11:
            continue
        sep, last, head = rng.choice(" --./ "), rng.random(), rng.random()
        groups = [_n(rng, k) for k in sizes]
        if rng.random() < 0.3:
            groups[0] = "0" + groups[0][1:]
        text = sep.join(groups[:-1]) + ("-" if last < 0.2 else sep) + groups[-1]
        if head < 0.25:
            text = f"({groups[0]}){rng.choice((' ', ''))}" + text[len(groups[0]) + 1 :]
        elif head < 0.3:
            text = "(0)" + text
        if zlib.crc32(form(text).encode()) % 3 == which:
            return text


def form(text: str) -> str:
    """A text with all digits alike."""
    return re.sub("[0-9]", "9", text)


#: What is personal by its form.
OTHERS = (
    [lambda r: _iban(r, ("DE", "FR", "ES")), lambda r: f"{_word(r)}{r.choice((' [at] ', '(at)', '[at]'))}{_word(r)}{r.choice((' [dot] ', '(dot)', '[dot]', '.'))}{r.choice(('com', 'org', 'net'))}", lambda r: ":".join(f"{r.randrange(256):02x}" for _ in range(6))],
    [lambda r: _iban(r, ("NL", "IT", "PT")), lambda r: f"{_word(r)}.{_word(r)}{r.choice(('(at)', '[at]'))}{_word(r)}{r.choice(('(dot)', '.'))}{r.choice(('info', 'edu'))}", lambda r: "-".join(f"{r.randrange(256):02X}" for _ in range(6))],
    [lambda r: _iban(r, ("AT", "PL", "BE")), lambda r: f"{_word(r)}_{_n(r, 2)}{r.choice((' [at] ', '(at)'))}{_word(r)}{r.choice((' [dot] ', '[dot]', '.'))}{r.choice(('de', 'fr', 'io'))}", lambda r: ":".join(f"{r.randrange(256):02X}" for _ in range(6))],
)
#: What is not, by its form; none is in two sets.
NEITHER = (
    [lambda r: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda r: _n(r, r.randint(7, 12)), lambda r: " ".join(_n(r, r.randint(1, 5)) for _ in range(r.randint(5, 7))), lambda r: f"{_n(r, 1)}.{_n(r, 2)}.{_n(r, 4)}.{_n(r, 2)}", lambda r: _word(r) + _n(r, 8),
     lambda r: f"{_word(r)} at {_word(r)} dot {_word(r)} {_word(r)}", lambda r: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2030)}", lambda r: "AB" + _n(r, 2) + " " + _n(r, 4) + " " + _n(r, 4), lambda r: "http://" + _word(r) + ".com/" + _n(r, 10), lambda r: "/".join(_n(r, 4) for _ in range(3)), lambda r: f"{_n(r, 2)}.{_n(r, 3)}.{_n(r, 3)} EUR", lambda r: f"{_n(r, 2)} {_n(r, 3)} {_n(r, 3)} {r.choice(('km', 'items', 'EUR', 'kg'))}"],
    [lambda r: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)} {r.randint(10, 23)}:{r.randint(10, 59)}", lambda r: f"978-{_n(r, 1)}-{_n(r, 4)}-{_n(r, 4)}-{_n(r, 1)}", lambda r: f"{_n(r, 2)},{_n(r, 3)},{_n(r, 3)}.00", lambda r: f"{_n(r, 1)}-{_n(r, 1)} {_n(r, 2)}-{_n(r, 2)} {_n(r, 2)}", lambda r: _n(r, r.randint(13, 16)), lambda r: f"{_n(r, 3)} {_n(r, 3)} {_n(r, 3)} kg"],
    [lambda r: f"{r.randint(1900, 2030)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}", lambda r: f"{_n(r, 2)}.{_n(r, 5)}, {_n(r, 2)}.{_n(r, 5)}", lambda r: f"{_n(r, 4)}-{_n(r, 4)} pages", lambda r: f"{_word(r)}_{_n(r, 9)}", lambda r: f"{_n(r, 1)}.{_n(r, 1)}.{_n(r, 2)}-{_n(r, 4)}", lambda r: f"{r.randint(1, 12)}/{r.randint(1900, 2030)} {r.randint(1, 12)}/{r.randint(1900, 2030)}"],
)


def example_texts(which: int, n: int = 2800) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(text, its spans) of a set: 0 for training, 1 for calibration, 2 for the test. Numbers of one form are personal behind some words and not behind others."""
    rng = random.Random(which + 1)
    good, bad = PHRASES[which]
    for k in range(2 * n):
        head, tail = f"{_word(rng)} {_word(rng)} " * (rng.random() < 0.8), None
        if k % 2:
            if k % 8 < 6:
                if rng.random() < 0.65:
                    head += rng.choice(good)
                else:  # words behind, or none
                    head += f"{NEITHER[which][0](rng)} " if rng.random() < 0.5 else ""
                    tail = f" {rng.choice(good).strip(' :')}" if rng.random() < 0.6 else None
                made = [_number(rng, which)]
                made += [re.sub("[0-9]", lambda m: rng.choice("0123456789"), made[0]) for _ in range(rng.choice((0, 0, 0, 1, 2)))]
            else:
                head += rng.choice((*good, *bad, "", "", ""))
                made = [rng.choice(OTHERS[which])(rng)]
        elif k % 4:
            behind = rng.random() < 0.15
            head, made = head + rng.choice(bad) * (not behind), [_number(rng, which)]
            tail = f" {rng.choice(bad).strip(' :')}" if behind else None
        else:
            head, made = head + rng.choice((*bad, "", "", "")), [rng.choice(NEITHER[which])(rng)]
        text, spans, between = head, [], rng.choice((" ", " ", ", ", " / ", "; "))
        for m in made:
            text += between * bool(spans)
            spans.append((len(text), len(text) + len(m)))
            text += m
        if tail is None:
            tail = rng.choice((" ", ". ", ", ", "; ")) + _word(rng) if rng.random() < 0.8 else ""
        yield text + tail, spans if k % 2 else []


def _examples(which: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, Span]]]:
    """Features of all candidates of a set, which are right, and where they stand: (number of the text, span)."""
    x, y, at = [], [], []
    for k, (text, spans) in enumerate(example_texts(which)):
        taken = _Taken(base_spans(text))
        for c, row in scored_candidates(text, taken):
            x.append(row)
            y.append((c.start, c.end) in spans)
            at.append((k, c[:3]))
    return np.array(x), np.array(y, float), at


def _resolved(p: np.ndarray, at: list[tuple[int, Span]]) -> list[int]:
    """Candidates that overlap no better one, the best first."""
    out, taken = [], {}
    for j in sorted(range(len(p)), key=lambda j: (-p[j], at[j])):
        k, span = at[j]
        own = taken.setdefault(k, _Taken([]))
        if own.free(span):
            own.add(span)
            out.append(j)
    return out


@lru_cache(maxsize=1)
def trained() -> bytes:
    """Pickled (trees, threshold per kind)."""
    x, y, _ = _examples(0)
    trees = BoostedTrees().fit(x, y)
    x, y, at = _examples(1)
    p = trees.probability(x)
    kept = np.array(_resolved(p, at))
    thresholds = {}
    for k, kind in enumerate(ADDED):
        own = kept[x[kept, 0] == k]
        hits = np.cumsum(y[own]) / np.arange(1, len(own) + 1)
        last = np.append(np.diff(p[own]) != 0, True)  # equal scores are selected together
        enough = np.flatnonzero((hits >= PRECISION) & last)
        thresholds[kind] = max(0.5, float(p[own[enough[-1]]])) if len(enough) else 2.0
    return pickle.dumps((trees, thresholds))


@lru_cache(maxsize=1)
def _loaded(packed: bytes) -> tuple[BoostedTrees, dict[str, float]]:
    return pickle.loads(packed)


#: Candidates that are scored at once.
SCORED = 4096


def added_spans(texts: list[str], base: list[list[Span]], packed: bytes) -> list[list[Span]]:
    """For each text the candidates that the trees select; features of SCORED candidates are held at once, and of the rest those that reach their threshold."""
    trees, thresholds = _loaded(packed)
    taken, high = [_Taken(b) for b in base], [[] for _ in texts]
    found = ((i, c[:3], row) for i, text in enumerate(texts) for c, row in scored_candidates(text, taken[i]))
    while some := list(islice(found, SCORED)):
        for p, (i, span, _) in zip(trees.probability(np.array([row for _, _, row in some])).tolist(), some, strict=True):
            if p >= thresholds[span[2]]:
                high[i].append((-p, span))
    out: list[list[Span]] = [[] for _ in texts]
    for i, own in enumerate(high):
        for _, span in sorted(own):
            if taken[i].free(span):
                taken[i].add(span)
                out[i].append(span)
    return out


class _Taken:
    """Disjoint intervals in order."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for start, end, _ in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, span: Span) -> bool:
        at = bisect_left(self.starts, span[1])
        return at == 0 or self.ends[at - 1] <= span[0]

    def add(self, span: Span) -> None:
        at = bisect_left(self.starts, span[0])
        self.starts.insert(at, span[0])
        self.ends.insert(at, span[1])


_ORDER = {k: i for i, k in enumerate(BASE + ADDED)}


def all_spans(texts: list[str], packed: bytes) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans by start, then kind) of each text."""
    base = [base_spans(t) for t in texts]
    more = added_spans(texts, base, packed)
    return [(b, sorted(b + m, key=lambda s: (s[0], _ORDER[s[2]]))) for b, m in zip(base, more, strict=True)]


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def personal_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, start, end, value): a row for each span."""
    packed = trained()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [(i, k, s, e, t[s:e]) for i, t, (_, spans) in zip(batch.column(0).to_pylist(), texts, all_spans(texts, packed), strict=True) for s, e, k in spans]
            c = list(zip(*rows, strict=True)) or [()] * 5
            yield arrow_batch({id_col: (list(c[0]), pa.int64()), "kind": (list(c[1]), pa.string()), "start": (list(c[2]), pa.int64()), "end": (list(c[3]), pa.int64()), "value": (list(c[4]), pa.string())})

    return mapped(df.select(F.col(id_col).cast("long").alias(id_col), text_column(text_col).alias("text")), run, f"{id_col} long, kind string, start long, end long, value string")


def personal_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts and digest of the base kinds, all spans as text."""
    packed = trained()

    def run(batches):
        for batch in batches:
            both = all_spans(batch.column(1).to_pylist(), packed)
            counts = {f"n_{k}": ([sum(x[2] == k for x in b) for b, _ in both], pa.int64()) for k in BASE}
            yield arrow_batch({id_col: (batch.column(0), pa.int64()), **counts, "base_sha256": ([hashlib.sha256(span_text(b).encode()).hexdigest() for b, _ in both], pa.string()), "spans": ([span_text(s) for _, s in both], pa.string()), "n_spans": ([len(s) for _, s in both], pa.int64())})

    return mapped(df.select(F.col(id_col).cast("long").alias(id_col), text_column(text_col).alias("text")), run, f"{id_col} long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def op2_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digests(table(spark, sf_dir, "documents"))
