"""Store operations as transforms: upserts, requeues, retention, append without conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last change wins by key, over what is stored; ``changes`` has the columns of ``stored`` and ``order``."""
    values = [c for c in stored.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in values if c not in order])).alias("m")).select(*keys, *[F.col(f"m.{c}").alias(f"new_{c}") for c in values], F.lit(True).alias("changed"))
    joined = stored.join(last, keys, "full")
    return joined.select(*keys, *[F.when(F.col("changed"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in values])


@query("""SELECT user_id, event_type, last(event_id ORDER BY ts, event_id) AS event_id, count(*) AS n_writes, round(max(value), 6) AS top FROM events GROUP BY 1, 2""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n_writes"), F.round(F.max("value"), 6).alias("top"))


@query("""SELECT CASE WHEN event_type = 'error' AND ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY THEN 'view' ELSE event_type END AS state, count(*) AS n FROM events GROUP BY 1""")
def stale_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors older than a week before the last event go back to the start.  The bound is one row."""
    e = table(spark, sf_dir, "events")
    bound = e.agg((F.max("ts") - F.expr("interval 7 days")).alias("bound"))
    state = F.when((F.col("event_type") == "error") & (F.col("ts") < F.col("bound")), "view").otherwise(F.col("event_type"))
    return e.join(F.broadcast(bound), F.lit(True)).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, c_name, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY ORDER BY o_orderdate, o_orderkey LIMIT 50""")
def retention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest open orders past retention: a batch of fifty, as the feature has it."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    bound = F.broadcast(o.agg((F.max("o_orderdate") - F.expr("interval 365 days")).alias("bound")))
    old = o.where("o_orderstatus = 'O'").join(bound, F.col("o_orderdate") < F.col("bound"))
    return old.join(c, old["o_custkey"] == c["c_custkey"]).orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "c_name", F.to_date("o_orderdate").alias("day"))


@query("""SELECT n_name, count(*) AS n_new FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY 1""")
def append_without_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to append: those whose key is not stored."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    stored = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    new = c.join(stored, c["c_custkey"] == stored["o_custkey"], "left_anti")
    return new.join(n, new["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.count("*").alias("n_new"))


@query("""SELECT d.doc_id, coalesce(bool_or(toxic = 1), false) AS visible_to_reviewer FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id""")
def row_level_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with whether a reviewer of toxic ones may see them: the policy is a join, not a global."""
    mine = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.bool_or(F.col("toxic") == 1).alias("mine"))
    return table(spark, sf_dir, "documents").select("doc_id").distinct().join(mine, "doc_id", "left").select("doc_id", F.coalesce("mine", F.lit(False)).alias("visible_to_reviewer"))
