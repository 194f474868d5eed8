"""Main text of web pages by nearest-URL page differencing (operator 8).

Method. A page is cut into lines, one for each block of text, each with the path of elements it stands in. Pages are sorted
by host, then path; of the pages before and after a page, the one on the same host whose path shares the longer beginning is
its pair. The lines of both (path and text) are aligned by a longest common subsequence, and the shared ones are deleted.
Two things that the elements say are kept beside it, for what differencing can't tell. Lines inside an `article` or `main`
element stay although the pair has them, as articles share whole sentences; and only these lines are the text of a page that
has such an element. Lines in elements that by name never hold an article (menus, headers, footers, sidebars, forms, and
those named as notices, adverts or comments) go although the pair has others, as menus and adverts differ from page to page.

Only hashes of lines are sorted and compared, one row for each different page of a host, so copies of a page are never its
pair. Pages whose lines differencing deletes are joined with the numbers of these lines; texts are not moved.

Inside a block, character references are decoded and white space becomes one space; blocks are joined by an empty line. Tags
are read in one pass over the page, however damaged it is; end tags that may be left out are supplied, and furniture that is
never closed ends where an article or a main heading begins. A class is the name of furniture for what it stands on, unless that
holds the article or main heading and more than half of the page's text: then it tells of the layout, such as `right-sidebar`.

Cases: null html gives an empty text; a null URL has an empty host and path; a page without a neighbour on its host is only
cut, not compared; repeated pages and repeated ids are judged alike and row by row; very long pages take time in proportion,
and their alignment bounded memory; an empty table gives no rows; other columns are ignored. Sorting is by ranges, so a host
with a third of all pages is spread over tasks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelore.llm.common import arrow_batch, bounded, forget, mapped, spark_schema, stored, table, text_hash
from bytelore.llm.neighbours import with_neighbours
from bytelore.llm.urls import url_parts

JOIN = "\n\n"

#: Names of elements.
LEFT_OUT = frozenset("head script style noscript template nav header footer aside form button select textarea iframe svg canvas object audio video dialog menu title".split())
NEVER_TEXT = frozenset("head script style noscript template title iframe svg canvas object audio video".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
#: Elements whose end tag may be left out: (names that end an open one, elements that hide it).
IMPLIED = (
    (CLOSES_P, frozenset("table td th caption button object template".split())),
    (frozenset(["li"]), frozenset("ul ol menu".split())),
    (frozenset(("dt", "dd")), frozenset(["dl"])),
    (frozenset("tr tbody thead tfoot".split()), frozenset(["table"])),
    (frozenset("td th tr tbody thead tfoot".split()), frozenset(["table"])),
    (frozenset(("option", "optgroup")), frozenset(["select"])),
)
KINDS = {"p": 0, "li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
#: Words in classes, ids and roles. The first name furniture by themselves, the second if nothing but furniture is named beside them.
FURNITURE = frozenset("advert advertisement advertising sponsor sponsored cookie cookies consent gdpr popup modal overlay nav navbar navigation navi menu breadcrumb breadcrumbs sidebar footer comment comments commentlist commentform disqus responses replies sharing newsletter subscribe contentinfo".split())
FURNITURE_ALONE = frozenset("ad ads adv related recommended share social search notice banner promo widget complementary reviews discussion".split())
BESIDE = frozenset("slot unit label space zone google sense area articles bar block box btn button buttons container content form icons inner items links list media module news panel posts section stories top bottom left right wrap wrapper".split())
STATES = ("has-", "no-", "with-", "is-", "js-")
_ARTICLE_OUT = re.compile(r"(?:comments?|reply|ads?|advert|advertisement|sponsored)(?:-\d+)?")

_TAG = re.compile(r"""([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(>?)""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']*+)))?+""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


#: Open pieces of furniture that are told apart; what is nested more deeply counts with the innermost of these.
NESTED = 64


class Line(NamedTuple):
    text: str
    inside: bool  # of an article or main element
    out: bool  # in furniture by the names of elements
    path: int


class _Furniture:
    def __init__(self, by_class: bool, headline: bool):
        self.by_class, self.headline = by_class, headline
        self.closed, self.ends = False, None  # ends: number of the first line behind it, if it isn't closed
        self.begun = False  # an article or a main heading begins in it


def _named_out(name: str, attributes: str) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            for value in (m[2] or m[3] or m[4] or "").split():
                if name in CONTENT:
                    if _ARTICLE_OUT.fullmatch(value.lower()):
                        return True
                elif not value.lower().startswith(STATES):
                    parts = {p.lower() for p in _PART.findall(value)}
                    if parts & FURNITURE or (parts & FURNITURE_ALONE and parts <= FURNITURE_ALONE | BESIDE):
                        return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(name, attributes, text, closing): text has no name. Every character is looked at once; a tag that never ends takes the rest."""
    at = start = 0
    n = len(page)
    while (lt := page.find("<", at)) >= 0:
        m, closing = None, page.startswith("/", lt + 1)
        begin = lt + 1 + closing
        if begin < n and page[begin].isascii() and page[begin].isalpha():
            m = _TAG.match(page, begin)
            end = m.end()
        elif page.startswith("!--", lt + 1):
            end = next((lt + len(x) for x in ("<!-->", "<!--->") if page.startswith(x, lt)), 0) or page.find("-->", lt + 4) + 3
            end = end if end > 2 else n
        elif closing or page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt) + 1 or n
        else:
            at = lt + 1
            continue
        if lt > start:
            yield "", "", page[start:lt], False
        start = at = end
        if m and m[3]:
            name = m[1].lower()
            yield name, m[2], "", closing
            if name in RAW and not closing:
                raw_end = _RAW_END[name].search(page, at)
                start = at = raw_end.start() if raw_end else n
    if start < n:
        yield "", "", page[start:], False


class _Kind:
    """What a name says about an element."""

    __slots__ = ("inline", "void", "content", "never", "heading", "left_out", "ends", "own", "hides", "begins")

    def __init__(self, name: str):
        self.inline, self.void = name in INLINE, name in VOID
        self.content, self.never, self.heading, self.left_out = name in CONTENT, name in NEVER_TEXT, name in HEADINGS, name in LEFT_OUT
        self.begins = self.content or name == "h1"
        self.ends = [k for k, (names, _) in enumerate(IMPLIED) if name in names]
        self.own = KINDS.get(name, -1)
        self.hides = [k for k, (_, names) in enumerate(IMPLIED) if name in names]


class _Kinds(dict):
    def __missing__(self, name: str) -> _Kind:
        if len(self) > 1000:
            self.clear()
        self[name] = kind = _Kind(name)
        return kind


_kinds = _Kinds()
_WHICH = re.compile("class|id|role", re.I)


def lines(page: str) -> list[Line]:
    """The blocks of a page that can be read, in page order."""
    found: list[tuple[str, bool, int, tuple[_Furniture, ...]]] = []
    held: list[str] = []
    # (name, kind, furniture, is content, path, places of the nearest open elements whose end tag may be left out or -1)
    stack: list[tuple] = [("", _kinds[""], None, False, 0, (-1,) * (max(KINDS.values()) + 1))]
    opened: dict[str, int] = {}
    paths: dict[tuple[int, str], int] = {}
    furniture: list[_Furniture] = []
    content = never = heading = 0
    muted = 0  # place of an open inline element that is left out

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            found.append((text, content > 0, stack[-1][4], tuple([f for f in furniture if not (f.headline and heading)]) if furniture else ()))

    def pop(explicit: bool) -> None:
        nonlocal content, never, heading, muted
        name, kind, own, is_content, _, _ = stack.pop()
        if muted == len(stack):
            muted = 0
        opened[name] -= 1
        content -= is_content
        never -= kind.never
        heading -= kind.heading
        if own:
            furniture.pop()
            own.closed = explicit or name in KINDS

    for name, attributes, text, closing in tokens(page):
        if not name:
            if not never and not muted:
                held.append(html.unescape(text) if "&" in text else text)
            continue
        if closing and not opened.get(name):
            continue
        kind = _kinds[name]
        inline = kind.inline
        if not inline:
            if held:
                flush()
            muted = 0
        if closing:
            at = len(stack) - 1
            while stack[at][0] != name and not (inline and not stack[at][1].inline):
                at -= 1
            if stack[at][0] == name:
                while len(stack) > at:
                    pop(name not in ("body", "html"))
            continue
        if kind.void:
            if name == "br" and not never:
                held.append(" ")
            continue
        for k in kind.ends:
            while 0 < stack[-1][5][k]:
                pop(True)
        if kind.begins:
            for f in furniture:
                f.ends, f.begun = len(found) if f.ends is None else f.ends, True
        if not inline and attributes.endswith("/"):
            continue
        by_class = bool(attributes) and _WHICH.search(attributes) is not None and name not in ("html", "body") and _named_out(name, attributes)
        _, _, _, _, path, near = stack[-1]
        own, here = None, len(stack)
        if inline:
            if by_class and not muted:
                muted = here
        else:
            if (by_class or kind.left_out) and len(furniture) < NESTED:
                own = _Furniture(by_class and not kind.left_out, name == "header" and content > 0)
                furniture.append(own)
            step = (path, name)
            if step not in paths:
                paths[step] = xxhash.xxh64_intdigest(f"{path} {name}")
            path = paths[step]
        if kind.hides or kind.own >= 0:
            changed = list(near)
            for k in kind.hides:
                changed[k] = -1
            if kind.own >= 0:
                changed[kind.own] = here
            near = tuple(changed)
        is_content = kind.content and not by_class
        stack.append((name, kind, own, is_content, path, near))
        opened[name] = opened.get(name, 0) + 1
        content += is_content
        never += kind.never
        heading += kind.heading
    if held:
        flush()
    if all(not fs for _, _, _, fs in found):
        return [Line(text, inside, False, path) for text, inside, path, _ in found]
    layout = _layouts(found)
    out = lambda k, fs: any(f not in layout and (f.closed or f.ends is None or k < f.ends) for f in fs)
    done = [Line(text, inside, out(k, fs), path) for k, (text, inside, path, fs) in enumerate(found)]
    if not any(x.inside and not x.out for x in done):  # an article in an element that is named like furniture, and none elsewhere
        done = [x._replace(out=out(k, [f for f in fs if not f.by_class])) if x.inside else x for k, (x, (_, _, _, fs)) in enumerate(zip(done, found, strict=True))]
    return done


def _layouts(found: list[tuple[str, bool, int, tuple[_Furniture, ...]]]) -> set[_Furniture]:
    """Elements that only their class names furniture, but that hold the article or main heading and most of the page: classes of a layout, such as `right-sidebar`."""
    held: dict[_Furniture, int] = {}
    for text, _, _, fs in found:
        for f in fs:
            if f.by_class and f.begun:
                held[f] = held.get(f, 0) + len(text)
    total = sum(len(text) for text, _, _, _ in found)
    return {f for f, n in held.items() if 2 * n > total}


#: Bits of the table of an alignment that is kept whole; a larger one is halved.
WHOLE = 1 << 26


def shared(a: list, b: list) -> list[bool]:
    """Which entries of a lie on a longest common subsequence with b."""
    out = [False] * len(a)
    start, end_a, end_b = 0, len(a), len(b)
    while start < min(end_a, end_b) and a[start] == b[start]:
        out[start] = True
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
        out[end_a] = True
    both = set(a[start:end_a]) & set(b[start:end_b])
    x = [i for i in range(start, end_a) if a[i] in both]
    _mark(x, [a[i] for i in x], [b[j] for j in range(start, end_b) if b[j] in both], out)
    return out


def _rows(a: list, b: list, keep: bool) -> tuple[list[int], int]:
    """Rows of the bit-parallel table: a zero bit marks a place of b where the length grows."""
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    rows = []
    for x in a:
        if keep:
            rows.append(v)
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return rows, v


def _lengths(v: int, n: int) -> list[int]:
    """Length of the longest common subsequence with each beginning of b."""
    out = [0]
    for c in reversed(f"{v:0{n}b}"[-n:] if n else ""):
        out.append(out[-1] + (c == "0"))
    return out


def _mark(x: list[int], a: list, b: list, out: list[bool]) -> None:
    todo = [(x, a, b)]
    while todo:
        x, a, b = todo.pop()
        if len(a) > 1 and len(a) * len(b) > WHOLE:
            half = len(a) // 2
            head, tail = _lengths(_rows(a[:half], b, False)[1], len(b)), _lengths(_rows(a[half:][::-1], b[::-1], False)[1], len(b))
            cut = max(range(len(b) + 1), key=lambda j: head[j] + tail[len(b) - j])
            todo += [(x[:half], a[:half], b[:cut]), (x[half:], a[half:], b[cut:])]
            continue
        rows, after = _rows(a, b, True)
        j = len(b)
        length = lambda v, j: j - (v & ((1 << j) - 1)).bit_count()
        for k in range(len(a) - 1, -1, -1):
            before = rows[k]
            while j and length(after, j - 1) == length(after, j):
                j -= 1
            if j and length(before, j) < length(after, j):
                out[x[k]] = True
                j -= 1
            after = before


def main_text(found: list[Line], deleted: list[int] | None = None) -> str:
    """Text of the lines inside an article or main element if there are any, else of all that is no furniture and not deleted."""
    gone = set(deleted or ())
    inside = any(x.inside and not x.out for x in found)
    return JOIN.join(x.text for k, x in enumerate(found) if not x.out and (x.inside if inside else k not in gone))


def line_hash(x: Line) -> int:
    return xxhash.xxh64_intdigest(f"{x.path} {x.text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def page_lines(rows: DataFrame) -> DataFrame:
    """(host, h, path, lines, kept): hashes of the lines of each different page of a host, and which of them nothing but the pair can delete."""

    def run(batches):
        for batch in batches:
            found = [lines(x) for x in batch.column("html").to_pylist()]
            inside = [any(x.inside and not x.out for x in f) for f in found]
            kept = [[k for k, x in enumerate(f) if not x.out and not any_inside] for f, any_inside in zip(found, inside, strict=True)]
            yield arrow_batch({"host": (batch.column("host"), pa.string()), "h": (batch.column("h"), pa.binary()), "path": (batch.column("path"), pa.string()), "lines": ([[line_hash(x) for x in f] for f in found], pa.list_(pa.int64())), "kept": (kept, pa.list_(pa.int32()))})

    whole = mapped(rows.select("host", "h", "path", "html"), run, "host string, h binary, path string, lines array<long>, kept array<int>")
    return whole.groupBy("host", "h").agg(F.min(F.struct("path", "lines", "kept")).alias("page")).select("host", "h", "page.*")


def deletions(pages: DataFrame) -> DataFrame:
    """(host, h, n_shared, deleted): how many lines of each page its pair has, and the numbers of those that are deleted for that."""

    def make(before, row, after):
        host, h, path, own, kept = row
        near = [r for r in (before, after) if r is not None and r[0] == host]
        if not near:
            return host, h, 0, []
        both = shared(own, max(near, key=lambda r: _common(r[2], path))[3])
        return host, h, sum(both), [k for k in kept if both[k]]

    return with_neighbours(pages, ["host", "path", "h"], spark_schema(("host", "string"), ("h", "binary"), ("n_shared", "int"), ("deleted", "array<int>")), make)


def main_texts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page."""
    host, path = url_parts(url_col)
    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), text_hash(html_col).alias("h"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    lean = stored(page_lines(rows))
    compared = deletions(lean)
    gone = stored(compared.where(F.size("deleted") > 0).select("host", "h", "deleted"))
    forget(lean)

    def cut(batches):
        for batch in batches:
            found = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            texts = [main_text(lines(x), deleted) for x, deleted in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    whole = rows.join(bounded(gone, gone.count()), ["host", "h"], "left").select(id_col, url_col, "html", "deleted")
    return mapped(whole, cut, spark_schema((id_col, "long"), (url_col, "string"), ("text", "string"), ("n_chars", "long")))


def op8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
