"""Identification of files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelore.operators.identify import FormatIdentifier

BINARY_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def arriving(identifier: FormatIdentifier, folder: str, pattern: str = "*", files_each: int | None = None) -> DataFrame:
    """Streaming results of the files that appear in a folder. Each is judged alone, so there is no state and no watermark. Spark gives no row for an empty file."""
    reader = identifier.spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern)
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    files = reader.load(folder)
    return identifier.content(files.select(F.col("path").alias("object_id"), F.col("path").alias("filename"), "content"))


def write_arriving(results: DataFrame, path: str | None, checkpoint: str, available_now: bool = True, handler: Callable[[DataFrame, int], None] | None = None):
    """Starts a query that appends results as Parquet, or gives each batch of them to a handler (results, number of the batch)."""
    writer = results.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.foreachBatch(handler) if handler else writer.format("parquet").option("path", path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
