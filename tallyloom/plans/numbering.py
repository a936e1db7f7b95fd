"""Dense numbers in sorted order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import staged


def numbered(df: DataFrame, *order: str, name: str = "code") -> DataFrame:
    """``df`` with ``name``, from 0, in the order of columns: rows are sorted in ranges, and each range begins where the counts of those before
    it end.  Of rows alike in ``order`` any may come first."""
    ordered = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("__part", F.shiftright("__row", 33))
    parts = ordered.groupBy("__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))  # a row a partition
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("__part", (before - F.col("__first")).alias("__shift"))
    return ordered.join(starts, "__part").withColumn(name, F.col("__row") + F.col("__shift")).drop("__row", "__part", "__shift")
