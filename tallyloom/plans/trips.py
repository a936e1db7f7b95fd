"""A customer is a trip; orders are its legs and stays, line items its items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import table


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip, leg, arrive, leave: from an order's date to the trip's next one, half open."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return o.select(F.col("o_custkey").alias("trip"), F.col("o_orderkey").alias("leg"), F.to_date("o_orderdate").alias("arrive"), F.to_date(F.lead("o_orderdate").over(w)).alias("leave"))


def items(spark: SparkSession, sf_dir: str, n: int | None = None, *of_order: str) -> DataFrame:
    """trip, leg, day and what else an item has: line items with their order's customer, and more columns of it; with n dealt out by order into n parts."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("trip"), *of_order)
    i = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    if n:
        o, i = o.repartition(n, "o_orderkey"), i.repartition(n, "l_orderkey")
    return i.join(o, i["l_orderkey"] == o["o_orderkey"]).drop("o_orderkey")


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip, stay, check_in, check_out: an order's date to its last shipment."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    return o.join(last, o["o_orderkey"] == last["l_orderkey"]).select(F.col("o_custkey").alias("trip"), F.col("o_orderkey").alias("stay"), F.to_date("o_orderdate").alias("check_in"), F.to_date("last").alias("check_out"))


#: The same in SQL, to begin a WITH list.
LEGS_SQL = """legs AS (SELECT o_custkey AS trip, o_orderkey AS leg, CAST(o_orderdate AS DATE) AS arrive,
  CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS leave FROM orders)"""
ITEMS_SQL = """items AS (SELECT o_custkey AS trip, l.*, CAST(l_shipdate AS DATE) AS day FROM lineitem l JOIN orders ON o_orderkey = l_orderkey)"""
STAYS_SQL = """stays AS (SELECT o_custkey AS trip, o_orderkey AS stay, CAST(o_orderdate AS DATE) AS check_in, CAST(max(l_shipdate) AS DATE) AS check_out
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""
