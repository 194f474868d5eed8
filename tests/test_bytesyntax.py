import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from bytelore.functions.bytesyntax import IncompatibleSequence, compile_sequence, position_of
from bytelore.functions.containersyntax import compile_container_sequence

MASKS = [
    ("~07", lambda b: b & 0x07 != 0), ("~7f", lambda b: b & 0x7F != 0), ("~00", lambda b: True), ("[!~80]", lambda b: b & 0x80 == 0), ("[!~ff]", lambda b: b == 0), ("[!~87]", lambda b: b & 0x87 == 0),
    ("&07", lambda b: b & 0x07 == 0x07), ("&7f", lambda b: b & 0x7F == 0x7F), ("&00", lambda b: True), ("[!&80]", lambda b: b & 0x80 != 0x80), ("[!&87]", lambda b: b & 0x87 != 0x87), ("[!&ff]", lambda b: b != 0xFF),
]


def found(sequence, data, position="BOF", *offsets):
    return re.search(compile_sequence(sequence, position, *offsets).encode(), data) is not None


@pytest.mark.parametrize("sequence,holds", MASKS)
def test_masks_over_all_bytes(sequence, holds):
    assert [found(sequence, bytes([b])) for b in range(256)] == [holds(b) for b in range(256)]


@pytest.mark.parametrize("data,hit", [(b"\xab123\xcd\x02\x11\xff", True), (b"\xab123\xcd\x03\x11\xff", True), (b"\xab\n\r\x00\xcd\x02\xfe\xff", True), (b"\xab12\xcd\x02\x11\xff", False), (b"0\xab123\xcd\x02\x11\xff", False), (b"\xab123\xcd\x04\x11\xff", False), (b"\xab123\xcd\x02\x18\xff", False)])
def test_composite(data, hit):
    assert found("ab{3}cd(01|02|03)~07ff", data) == hit


def test_positions_and_offsets():
    assert found("41", b"xxA", "BOF", "2") and not found("41", b"xA", "BOF", "2")
    assert found("41", b"xxA", "BOF", "0", "2") and not found("41", b"xxxA", "BOF", "0", "2")
    assert found("41", b"xxxA", "BOF", "1", "3") and not found("41", b"A", "BOF", "1", "3")
    assert found("41", b"Axx", "EOF", "2") and not found("41", b"A\n", "EOF") and found("41", b"xA", "EOF")
    assert found("41", b"xxA", "VAR", "7") and found("4142", b"xxAB", "IFB", "2")
    assert compile_sequence("41", "IFB", "2", "5") == r"(?s)\A.{2,5}A"
    assert [position_of(x) for x in ("Absolute from BOF", "Absolute from EOF", "Variable", "Indirect From BOF", "?")] == ["BOF", "EOF", "VAR", "IFB", "VAR"]


@pytest.mark.parametrize("bad", ["4", "4x", "[41:", "[4142:43]", "(&01)", "{a}", "{1-", "?", "zz", "[!41:42]", "{-3}"])
def test_incompatible(bad):
    with pytest.raises(IncompatibleSequence):
        compile_sequence(bad)


PIECES = st.one_of(
    st.integers(0, 255).map(lambda b: (f"{b:02X}", lambda d, b=b: {1} if d[:1] == bytes([b]) else set())),
    st.tuples(st.integers(0, 255), st.integers(0, 255)).map(lambda r: (f"[{min(r):02x}:{max(r):02x}]", lambda d, r=r: {1} if d and min(r) <= d[0] <= max(r) else set())),
    st.integers(0, 255).map(lambda m: (f"&{m:02x}", lambda d, m=m: {1} if d and d[0] & m == m else set())),
    st.integers(0, 3).map(lambda n: (f"{{{n}}}", lambda d, n=n: {n} if len(d) >= n else set())),
    st.tuples(st.integers(0, 2), st.integers(0, 2)).map(lambda r: (f"{{{min(r)}-{max(r)}}}", lambda d, r=r: {n for n in range(min(r), max(r) + 1) if n <= len(d)})),
    st.just(("*", lambda d: set(range(len(d) + 1)))), st.just(("+", lambda d: set(range(1, len(d) + 1)))), st.just(("??", lambda d: {0, 1} if d else {0})),
    st.lists(st.integers(0, 255), min_size=1, max_size=3).map(lambda bs: ("(" + "|".join(f"{b:02x}" for b in bs) + ")", lambda d, bs=bs: {1} if d and d[0] in bs else set())),
)


@given(st.lists(PIECES, max_size=6), st.binary(max_size=8))
def test_random_sequences_against_an_interpreter(pieces, data):
    ends = {0}
    for _, step in pieces:
        ends = {e + n for e in ends for n in step(data[e:])}
    assert found("".join(t for t, _ in pieces), data) == bool(ends)


def test_container_sequences():
    rx = compile_container_sequence("'Word' 00 ['6' '8'-41]")
    hit = lambda b: re.search(rx.encode(), b) is not None
    assert hit(b"..Word\x006") and hit(b"Word\x008") and hit(b"Word\x00A") and not hit(b"Word\x007")
