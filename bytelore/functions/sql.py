"""Names for SQL: the compiler of byte sequences, a test of windows, and the members of archives as a table function.

After `register(spark)`: `compile_sequence(sequence, position)` gives the expression of a sequence (null if it can't be
compiled), `matches(content, sequence, position)` tells whether it holds in a window, and `archive_members(filename, content)`
is a table (name, size, first bytes) of an archive's regular members, for LATERAL.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bytelore import schema
from bytelore.functions.bytesyntax import IncompatibleSequence, compile_sequence
from bytelore.functions.reach import reach
from bytelore.sources import archives

HEAD = 64


def expression(sequence: str | None, position: str | None) -> str | None:
    try:
        return compile_sequence(sequence, position) if sequence is not None and position is not None else None
    except IncompatibleSequence:
        return None


@lru_cache(maxsize=4096)
def _test(sequence: str | None, position: str | None):
    regex = expression(sequence, position)
    return None if regex is None else reach(regex, position) or re.compile(regex.encode())


def holds(content: bytes | None, sequence: str | None, position: str | None, size: int = schema.BUFFER) -> bool | None:
    """Whether a sequence holds in the window of an object that its position looks at; null if one of them is, or if it can't be compiled."""
    test = _test(sequence, position)
    if content is None or test is None:
        return None
    if position == "EOF":
        return test.search(content[-size:]) is not None
    return (test.match if position == "BOF" else test.search)(content[:size]) is not None


class ArchiveMembers:
    """Members of a zip or tar file, in order; those before the damage, if there is some."""

    def eval(self, filename: str, content: bytes) -> Iterator[tuple[str, int, bytes]]:
        data = bytes(content or b"")
        kind = "zip" if data[:2] == b"PK" else "tar"
        try:
            for name, size, opened in archives._entries(io.BytesIO(data), kind):
                with opened() as f:
                    yield f"{filename}!{name}", size, f.read(HEAD)
        except archives.BROKEN:
            return


def register(spark: SparkSession) -> None:
    compiled = F.pandas_udf(lambda s, p: pd.Series([expression(a, b) for a, b in zip(s, p, strict=True)], dtype=object), "string")
    tested = F.pandas_udf(lambda c, s, p: pd.Series([holds(None if a is None else bytes(a), b, d) for a, b, d in zip(c, s, p, strict=True)], dtype=object), "boolean")
    spark.udf.register("compile_sequence", compiled)
    spark.udf.register("matches", tested)
    spark.udtf.register("archive_members", F.udtf(ArchiveMembers, returnType="name string, size bigint, head binary"))
