"""Typed records: projections, keyed decisions, compare-and-set, replay of a decision log, publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table


@query("""SELECT o_orderkey, o_custkey AS trip, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS sort_order,
 'city:' || lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '-', 'g')) || ':' || lower(regexp_replace(r_name, '[^A-Za-z0-9]+', '-', 'g')) AS city_key
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def legs_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as legs, in order, with their city's key."""
    slug = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"))
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    c = table(spark, sf_dir, "customer").join(place, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.concat_ws(":", F.lit("city"), slug("n_name"), slug("r_name")).alias("city_key"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    order = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return o.withColumn("sort_order", order).join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_custkey").alias("trip"), "sort_order", "city_key")


@query("""SELECT kind, count(*) AS n FROM (
  SELECT 'order' AS kind, o_orderkey AS id FROM orders WHERE o_orderstatus = 'O'
  UNION SELECT 'order', l_orderkey FROM lineitem WHERE l_returnflag = 'R'
  UNION SELECT 'customer', o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION SELECT 'customer', c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY kind""")
def review_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that need a review, each once."""
    o, li, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    key = lambda df, kind, id_: df.select(F.lit(kind).alias("kind"), F.col(id_).alias("id"))
    keys = key(o.where("o_orderstatus = 'O'"), "order", "o_orderkey").union(key(li.where("l_returnflag = 'R'"), "order", "l_orderkey"))
    keys = keys.union(key(o.where("o_orderpriority = '1-URGENT'"), "customer", "o_custkey")).union(key(c.where("c_acctbal < 0"), "customer", "c_custkey"))
    return keys.distinct().groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, sha256(o_custkey || ':order:' || o_orderkey || ':' || CASE o_orderstatus WHEN 'F' THEN 'confirm' WHEN 'O' THEN 'edit' ELSE 'protect' END) AS decision_key FROM orders""")
def decision_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key ``trip:type:id:action``, hashed."""
    action = F.when(F.col("o_orderstatus") == "F", "confirm").when(F.col("o_orderstatus") == "O", "edit").otherwise("protect")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat_ws(":", "o_custkey", F.lit("order"), "o_orderkey", action), 256).alias("decision_key"))


@query("""SELECT o_orderstatus AS was, CASE WHEN o_orderstatus = 'P' AND n > 0 THEN 'F' ELSE o_orderstatus END AS now, count(*) AS n
FROM (SELECT o.*, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linestatus = 'F') AS n FROM orders o) GROUP BY ALL""")
def compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets a state only where it is still the expected one and a change asks for it."""
    asked = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select("l_orderkey").distinct().withColumn("asked", F.lit(True))
    o = table(spark, sf_dir, "orders").join(asked, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    now = F.when((F.col("o_orderstatus") == "P") & F.col("asked").isNotNull(), "F").otherwise(F.col("o_orderstatus"))
    return o.groupBy(F.col("o_orderstatus").alias("was"), now.alias("now")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
d AS (SELECT user_id, max(k) FILTER (event_type = 'error') AS cut FROM r GROUP BY user_id)
SELECT r.user_id, count(*) FILTER (k > coalesce(cut, 0)) AS n_kept, CAST(count(*) - count(*) FILTER (k > coalesce(cut, 0)) AS BIGINT) AS n_undone, arg_max(event_type, k) AS last_action FROM r JOIN d ON d.user_id = r.user_id GROUP BY r.user_id""")
def decision_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds each user's log in order: an error undoes all before it.  What is left is what comes after the last
    one, so the fold is an aggregate of positions and needs no row gathered."""
    at = F.struct("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", at.alias("at"))
    cut = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("at"))).alias("cut"), F.max_by("event_type", "at").alias("last_action"))
    kept = (F.col("cut").isNull()) | (F.col("at") > F.col("cut"))
    return e.join(cut, "user_id").groupBy("user_id").agg(F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_undone"), F.first("last_action").alias("last_action"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'locked' WHEN c_mktsegment = 'BUILDING' THEN 'unlocked' END AS mode, CASE WHEN c_acctbal >= 0 AND c_mktsegment = 'BUILDING' THEN n END AS n_details
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def access_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locked trips show no details; unlocked ones do; others have no state."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left")
    mode = F.expr("case when c_acctbal < 0 then 'locked' when c_mktsegment = 'BUILDING' then 'unlocked' end")
    return c.select("c_custkey", mode.alias("mode"), F.when(mode == "unlocked", F.col("n")).alias("n_details"))


@query("""WITH l AS (SELECT l_orderkey, l_shipdate::DATE AS day, l_returnflag FROM lineitem)
SELECT o_orderkey, count(*) FILTER (l_returnflag = 'A' AND day - o_orderdate::DATE < 30) AS n_early, count(*) FILTER (l_returnflag = 'R') AS n_back,
 CASE WHEN count(*) FILTER (l_returnflag = 'R') > 1 THEN 'hard' WHEN count(*) FILTER (l_returnflag = 'A' AND day - o_orderdate::DATE < 30) > 0 THEN 'quiet' ELSE 'none' END AS warning
FROM orders JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def warnings_read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard and quiet warnings of each order, from counts of its items."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("start"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("day"), "l_returnflag")
    early = (F.col("l_returnflag") == "A") & (F.date_diff("day", "start") < 30)
    g = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.count_if(early).alias("n_early"), F.count_if(F.col("l_returnflag") == "R").alias("n_back"))
    return g.withColumn("warning", F.expr("case when n_back > 1 then 'hard' when n_early > 0 then 'quiet' else 'none' end"))


@query("""SELECT l_returnflag AS category, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders, CAST(sum(CASE l_linestatus WHEN 'F' THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM lineitem GROUP BY 1
UNION ALL SELECT s, 0, 0, 0 FROM (VALUES ('X'), ('Y')) t(s)""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared and used categories: those without items count zero."""
    li = table(spark, sf_dir, "lineitem")
    by_order = li.groupBy("l_returnflag", "l_orderkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("l_linestatus") == "F", 2).otherwise(1)).alias("w"))
    used = by_order.groupBy(F.col("l_returnflag").alias("category")).agg(F.sum("n").alias("n"), F.count("*").alias("n_orders"), F.sum("w").alias("weight"))
    declared = spark.createDataFrame([("X",), ("Y",)], "category string").select("category", *[F.lit(0).cast("bigint").alias(c) for c in ("n", "n_orders", "weight")])
    return used.union(declared)


@query("""SELECT o_custkey AS trip, max(o_orderdate)::DATE AS latest, count(*) AS n, min((CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey))[2] AS first_by_rank FROM orders GROUP BY 1""")
def lowest_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each trip the record of lowest rank, ties by key."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("trip")).agg(F.to_date(F.max("o_orderdate")).alias("latest"), F.count("*").alias("n"), F.min_by("o_orderkey", F.struct(rank, F.col("o_orderkey"))).alias("first_by_rank"))


@query("""WITH f AS (SELECT o_orderkey AS id, o_orderstatus AS fin FROM orders), i AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R')
SELECT CASE WHEN i.id IS NULL THEN 'new' WHEN fin = 'F' THEN 'fixed' WHEN fin = 'O' THEN 'persists' ELSE 'question' END AS outcome, count(*) AS n FROM f LEFT JOIN i ON i.id = f.id GROUP BY 1""")
def outcome_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings before and after: fixed, persisting, asked about, or new."""
    i = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct()
    f = table(spark, sf_dir, "orders").join(i, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    outcome = F.expr("case when l_orderkey is null then 'new' when o_orderstatus = 'F' then 'fixed' when o_orderstatus = 'O' then 'persists' else 'question' end")
    return f.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '5-LOW')""")
def owner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows an owner may see: a semi join for the right, an anti join for what is held back."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    mine = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    held = o.where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("c_custkey"))
    return c.select("c_custkey").join(mine, "c_custkey", "left_semi").join(held, "c_custkey", "left_anti")
