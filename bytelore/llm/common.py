"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelore.functions.batches import mapped, small_batches
from bytelore.sources.stored import forget, shared_dir, stored

__all__ = ["arrow_batch", "bounded", "forget", "held", "mapped", "shared_dir", "small_batches", "spark_schema", "stored", "table", "text_column", "text_hash", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_held: dict = {}


def held(key, make):
    """`make()`, kept in this worker until another key is asked for: what one operator remembers is gone when the next begins."""
    if key not in _held:
        if _held:
            _held.clear()
            gc.collect()
            _give_back()
        _held[key] = make()
    return _held[key]


def _give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: Rows of two numbers or a hash in a broadcast at most; above, the same join is shuffled.
BROADCAST_ROWS = 300_000


def bounded(df: DataFrame, n: int) -> DataFrame:
    """The small side of a join, of n rows: broadcast only below a size."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def text_hash(text_col: str) -> Column:
    """What tells texts apart: 16 bytes; none for a null text."""
    return F.coalesce(F.unhex(F.md5(F.col(text_col).cast("string"))), F.lit(b""))


def unused(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_column(name: str = "text") -> Column:
    """Whole text, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def spark_schema(*fields: tuple[str, str]) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t), True) for n, t in fields])


def arrow_batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))
