"""Compiler of container sequences to regular expressions over bytes.

Quoted text stands for itself, hex pairs for bytes; brackets hold alternatives, which blanks, dashes or nothing part;
white space outside quotes is ignored. The result is searched anywhere in a member or stream.
"""

from __future__ import annotations

import re

from bytelore.functions.escapes import escape

_TOKENS = re.compile(r"'(?P<text>[^']*)'|(?P<pair>[0-9A-Fa-f]{2})|(?P<mark>[\[\]])|(?P<blank>\s+)|(?P<other>.)", re.S)


def compile_container_sequence(sequence: str) -> str:
    out, group = [], None
    for m in _TOKENS.finditer(sequence):
        kind = m.lastgroup
        if kind in ("text", "pair"):
            piece = escape(m["text"]) if kind == "text" else escape(chr(int(m["pair"], 16)))
            if group is None:
                out.append(piece)
            else:
                group[-1] += piece
        elif kind == "mark":
            if m["mark"] == "[":
                group = [""]
            elif group is not None:
                out.append(f"({'|'.join(x for x in group if x)})")
                group = None
        elif group is not None and (kind == "blank" or m["other"] == "-"):
            group.append("")
        elif kind == "other" and group is None:
            out.append("\\" + m["other"])  # not part of the syntax; mostly no valid expression, and recorded as an error then
    return "(?s)" + "".join(out)
