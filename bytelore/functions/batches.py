"""Small batches for Python code: contents are large, and each task holds a batch several times over."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of a batch that goes to Python code at once.
BATCH_ROWS = 500

_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Lets Spark itself make batches of that size, too, which halves the memory of long contents. The registered queries ask
    for it, the operators don't; a session that sets the size of batches keeps it."""
    if spark.conf.get(_SETTING, _DEFAULT) == _DEFAULT:
        spark.conf.set(_SETTING, str(BATCH_ROWS))


def in_small_batches(query: Callable) -> Callable:
    @wraps(query)
    def run(spark, *rest):
        small_batches(spark)
        return query(spark, *rest)

    return run


def cut(run: Callable) -> Callable:
    """`run` on batches of BATCH_ROWS rows at most, whatever the session's size of batches is."""

    def small(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), BATCH_ROWS):
                yield batch.slice(at, BATCH_ROWS)

    return lambda batches: run(small(batches))


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """`df.mapInArrow` in small batches; the session's settings stay as they are."""
    return df.mapInArrow(cut(run), schema)
