"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the shared folder of the cluster.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is set only where none is and all tasks run in this
    process (tests on one machine); executors elsewhere could not read it, so there it is an error.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if base is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="checkpoint-"))
        base = sc.getCheckpointDir()
    return f"{base}/{uuid.uuid4().hex}"


#: Lets Spark delete the shuffle files of an execution when it ends; else they stay until the driver happens to collect its garbage.
_SHORT_LIVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read back: lineage ends here, so a lost executor costs only a read, and nothing
    reads the shuffle files behind the table any more."""
    path, conf = shared_dir(df.sparkSession), df.sparkSession.conf
    before = conf.get(_SHORT_LIVED, "false")
    conf.set(_SHORT_LIVED, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_SHORT_LIVED, before)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_path = path
    for scope in _scopes:
        scope.append(back)
    return back


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """A list of all tables that `stored` writes inside; at the end those that are still in it are deleted.

    What is to be read later is taken out of the list (`kept`) once nothing else is read any more.
    """
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)
        for df in made:
            forget(df)


def kept(df: DataFrame) -> DataFrame:
    """A stored table that outlives the scopes around it."""
    for scope in _scopes:
        scope[:] = [x for x in scope if x is not df]
    return df


def forget(df: DataFrame) -> None:
    """Deletes what `stored` wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """`df` partitioned by ranges of `order` and sorted. Rows that are equal in it may stand in any order, so many of them are spread over ranges, too."""
    tie = "_tie"
    while tie in {c.lower() for c in df.columns}:
        tie += "_"
    return df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).drop(tie)


def numbered(df: DataFrame, number: str, *order: str) -> DataFrame:
    """`df` with numbers from 1 in the order of `order`, without a window over all rows: places inside ranges, and the sizes of the ranges before."""
    rows = stored(ranged(df, *order).withColumn("_place", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_place", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_rows"))  # as many rows as partitions
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_place") - F.shiftleft(F.col("_part"), 33)
    return rows.join(F.broadcast(offsets), "_part").withColumn(number, F.col("_before") + inside + 1).drop("_place", "_part", "_before")
