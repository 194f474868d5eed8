"""Names of objects: extensions, archive members, registry records."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TAIL = re.compile(r"[^/.]\.*(\.[^/.]*)\Z")


def extension(name: str | None) -> str:
    """Lower-cased last extension without its dot; `` for names like `.bashrc`."""
    m = _TAIL.search(name or "")
    return m[1].lower().lstrip(".") if m else ""


def extension_column(name: Column | str) -> Column:
    """As `extension`, with built-in functions."""
    return F.ltrim(F.lower(F.regexp_extract(name, r"[^/.]\.*(\.[^/.]*)\z", 1)), F.lit("."))


def member_name(outer: Column | str, inner: Column | str) -> Column:
    return F.concat_ws("!", outer, inner)


def record_file_column(puid: Column | str) -> Column:
    """As `record_file`, with built-in functions."""
    parts = F.split(puid, "/")
    return F.concat(F.lit("puid."), parts[0], F.lit("."), parts[1], F.lit(".xml"))


def record_file(puid: str) -> str:
    """`fmt/12` -> `puid.fmt.12.xml`."""
    kind, number = puid.split("/")
    return f"puid.{kind}.{number}.xml"


def version_number(text: str) -> int | None:
    """`v116` or `116` -> 116; None for anything else."""
    m = re.fullmatch(r"[vV]?(\d+)", text)
    return int(m[1]) if m else None


def version_column(text: Column | str) -> Column:
    """As `version_number`, with built-in functions."""
    return F.nullif(F.regexp_extract(text, r"\A[vV]?(\d+)\z", 1), F.lit("")).cast("long")
