"""Structured Streaming over events: windows with a watermark, sessions and latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table's Parquet files as a stream, with its schema."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def tumbling(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; the same code runs on a table."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type") if events.isStreaming else events.groupBy(F.window("ts", length).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(24,6)")).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", F.round(F.col("total").cast("double"), 4).alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """A user's events with no gap of so long between them."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def ext_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(table(spark, sf_dir, "events"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"))
