"""Compiler of byte sequences (registry syntax) to regular expressions over bytes.

A sequence is read into a list of nodes by a small recursive reader, and the nodes are written out as one expression:
hex pairs, `&mm` (all bits of a mask), `~mm` (any bit), `[aa:bb]` ranges, `[!...]` exclusions (zero width), `(a|b|[x:y])`
alternatives, `{n}`, `{n-m}`, `{n-*}` gaps, and `*`, `+`, `??`. Anything else makes the sequence incompatible.
"""

from __future__ import annotations

from dataclasses import dataclass

from bytelore.functions.escapes import escape

#: Greatest repetition that is written out; windows are far smaller.
MOST = 4_000_000_000


class IncompatibleSequence(ValueError):
    """The sequence can't be expressed; its format loses the signatures collected so far."""


@dataclass
class Anchors:
    """What stands before and after the body of an expression."""

    before: str
    after: str


def anchors(position: str, offset: str | int | None = None, max_offset: str | int | None = None) -> Anchors:
    """Anchors of a position; `max_offset` is the absolute upper end of the gap, not its width."""
    low, high = _number(offset), _number(max_offset)
    gap = f".{{{low},{high}}}" if high else f".{{{low}}}" if low else ""
    if position in ("BOF", "IFB"):
        return Anchors(rf"(?s)\A{gap}", "")
    if position == "EOF":
        return Anchors("(?s)", rf"{gap}\Z")
    return Anchors("(?s)", "")  # a floating pattern has no use for offsets


def _number(text: str | int | None) -> int:
    if text in (None, ""):
        return 0
    try:
        value = int(text)
    except ValueError as e:
        raise IncompatibleSequence(f"not an offset: {text!r}") from e
    if not 0 <= value <= MOST:
        raise IncompatibleSequence(f"offset out of range: {value}")
    return value


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, expected: str) -> None:
        if self.peek(len(expected)) != expected:
            raise IncompatibleSequence(f"expected {expected!r} at {self.at} in {self.text!r}")
        self.at += len(expected)

    def byte(self) -> int:
        pair = self.peek(2)
        if len(pair) < 2 or not all(c in "0123456789abcdefABCDEF" for c in pair):
            raise IncompatibleSequence(f"not a byte at {self.at} in {self.text!r}")
        self.at += 2
        return int(pair, 16)

    def until(self, end: str) -> str:
        stop = self.text.find(end, self.at)
        if stop < 0:
            raise IncompatibleSequence(f"no {end!r} in {self.text!r}")
        part, self.at = self.text[self.at : stop], stop + len(end)
        return part


def _one(value: int) -> str:
    return escape(chr(value))


def _class(values: list[int]) -> str:
    """A class of bytes; `()` if there are none, which matches everywhere."""
    if not values:
        return "()"
    parts, start = [], values[0]
    for a, b in zip(values, [*values[1:], None], strict=True):
        if b != a + 1:
            parts.append(f"\\x{start:02x}" if a == start else f"\\x{start:02x}-\\x{a:02x}")
            start = b
    return f"[{''.join(parts)}]"


def _mask(sign: str, mask: int) -> str:
    fits = (lambda b: b & mask == mask) if sign == "&" else (lambda b: b & mask != 0)
    return _class([b for b in range(256) if fits(b)])


def _range(r: _Reader) -> str:
    """`[aa:bb]`, behind its bracket."""
    low = r.byte()
    if r.peek() != ":":
        raise IncompatibleSequence(f"a range of one byte is expected at {r.at} in {r.text!r}")
    r.take(":")
    high = r.byte()
    r.take("]")
    return f"[\\x{low:02x}-\\x{high:02x}]"


def _exclusion(r: _Reader) -> str:
    """`[!...]`, behind its mark: what follows must not begin so; no byte is used up."""
    out = []
    while (c := r.peek()) != "]":
        if c in ("&", "~") and c:
            r.at += 1
            out.append(_mask(c, r.byte()))
        else:
            out.append(_one(r.byte()))
    r.take("]")
    return f"(?!{''.join(out)})"


def _alternatives(r: _Reader) -> str:
    out = []
    while (c := r.peek()) != ")":
        if c == "|":
            r.at += 1
            out.append("|")
        elif c == "[":
            r.at += 1
            out.append(_range(r))
        else:
            out.append(_one(r.byte()))
    r.take(")")
    return f"(?:{''.join(out)})"


def _repetition(r: _Reader) -> str:
    text = r.until("}")
    low, dash, high = text.partition("-")
    if not low.isdigit() or (dash and high != "*" and not high.isdigit()):
        raise IncompatibleSequence(f"not a gap: {{{text}}}")
    return f".{{{low}}}" if not dash else f".{{{low},{'' if high == '*' else high}}}"


def body(sequence: str) -> str:
    r, out = _Reader(sequence), []
    while r.at < len(sequence):
        c = r.peek()
        if c in "&~":
            r.at += 1
            out.append(_mask(c, r.byte()))
        elif c == "[":
            r.at += 1
            if r.peek() == "!":
                r.at += 1
                out.append(_exclusion(r))
            else:
                out.append(_range(r))
        elif c == "(":
            r.at += 1
            out.append(_alternatives(r))
        elif c == "{":
            r.at += 1
            out.append(_repetition(r))
        elif c in "*+":
            r.at += 1
            out.append("." + c)
        elif c == "?":
            r.take("??")
            out.append(".?")
        else:
            out.append(_one(r.byte()))
    return "".join(out)


def compile_sequence(sequence: str, position: str = "BOF", offset: str | int | None = None, max_offset: str | int | None = None) -> str:
    """The expression of a sequence at a position (BOF, EOF, VAR or IFB)."""
    a = anchors(position, offset, max_offset)
    return a.before + body(sequence) + a.after


#: Position types of registry records.
POSITIONS = {
    "Absolute from BOF": "BOF",
    "Absolute from EOF": "EOF",
    "Variable": "VAR",
    "Indirect From BOF": "IFB",
}


def position_of(text: str) -> str:
    """Position of a record's position type; unknown types float."""
    return POSITIONS.get(text, "VAR")
