"""Escaping of text for regular expressions over bytes."""

#: Characters that stay as they are, and those that get a backslash.
LITERAL = frozenset(" \"#%&',-/0123456789:;=@ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz~")
BACKSLASHED = frozenset("$()*+.?![]^\\{|}")
NAMED = {"\n": "\\n", "\r": "\\r"}


def escape(text: str) -> str:
    """Every character as an expression that matches just it; `<`, `>` and all others become hex."""
    return "".join(c if c in LITERAL else f"\\{c}" if c in BACKSLASHED else NAMED.get(c, f"\\x{ord(c):02x}") for c in text)
