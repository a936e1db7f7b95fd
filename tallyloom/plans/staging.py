"""Tables written once and read several times, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a partition that one task sorts or holds, about.
ROWS = 300_000
#: The session's setting by which Spark deletes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read again: its lineage ends there and its size is known.
    Only where that folder is unset, as in a local test, is one made."""
    spark = df.sparkSession
    path = _path(spark, name)
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(*tables: DataFrame) -> int:
    """So many that each has some ``ROWS`` of the largest of these tables as they are read (their files know how many), and no fewer than a shuffle has."""
    return max(int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), *[t.count() // ROWS + 1 for t in tables])


def bucketed(df: DataFrame, by: list[str], n: int, name: str = "bucketed", then: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """``then`` of ``df``, written like ``staged`` but in n buckets of the columns ``by``, as a table of that folder.  Groups and windows whose keys have
    these, and joins on just these with a table of as many buckets, need no shuffle.  Rows are dealt out before ``then``, which keeps ``by``."""
    spark = df.sparkSession
    path = _path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    with _cleaned(spark):
        then(df.repartition(n, *by)).write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, *by).saveAsTable(table)
    return spark.table(table)


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """What is shuffled to make a table is not read again: its files go when the table stands."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _path(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
