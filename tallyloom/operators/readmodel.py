"""Aggregates and read models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.trips import items
from ..registry import query
from ..sources.tables import table


@query("""WITH c AS (SELECT n_nationkey, n_name, c_custkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey),
o AS (SELECT o_custkey, count(*) AS legs, count(*) FILTER (o_orderstatus = 'F') AS stays FROM orders GROUP BY 1), l AS (SELECT o_custkey, count(*) AS items FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT n_name, count(c_custkey) AS trips, coalesce(sum(legs), 0)::BIGINT AS legs, coalesce(sum(stays), 0)::BIGINT AS stays, coalesce(sum(items), 0)::BIGINT AS items
FROM c LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey GROUP BY n_name""")
def counts_read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips, legs, stays and items by nation.  Each fact is counted by customer before it is joined."""
    o = table(spark, sf_dir, "orders")
    by_trip = o.groupBy("o_custkey").agg(F.count("*").alias("legs"), F.count_if(F.col("o_orderstatus") == "F").alias("stays"))
    n_items = items(spark, sf_dir).groupBy(F.col("trip").alias("o_custkey")).agg(F.count("*").alias("items"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(by_trip.join(n_items, "o_custkey", "left"), F.col("c_custkey") == F.col("o_custkey"), "left")
    by_nation = c.groupBy("c_nationkey").agg(F.count("c_custkey").alias("trips"), *[F.sum(x).alias(x) for x in ("legs", "stays", "items")])
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return n.join(by_nation, n["n_nationkey"] == by_nation["c_nationkey"], "left").select("n_name", *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in ("trips", "legs", "stays", "items")])


def closed_counts(events: DataFrame, by: str) -> DataFrame:
    """``by``, event_type, n with zeros: every value of ``by`` has a row for every type, which is the result's size."""
    every = events.select(by).distinct().crossJoin(events.select("event_type").distinct())
    counts = events.groupBy(by, "event_type").agg(F.count("*").alias("k"))
    return every.join(counts, [by, "event_type"], "left").select(by, "event_type", F.coalesce("k", F.lit(0)).alias("n"))


@query("""WITH t AS (SELECT DISTINCT event_type FROM events), u AS (SELECT DISTINCT user_id % 16 AS bucket FROM events)
SELECT bucket, event_type, count(event_id) AS n FROM u CROSS JOIN t LEFT JOIN events e USING (event_type) WHERE e.user_id % 16 = bucket OR e.user_id IS NULL GROUP BY ALL
UNION ALL SELECT bucket, event_type, 0 FROM u CROSS JOIN t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = t.event_type AND e.user_id % 16 = bucket)""")
def counts_closed_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by bucket of users and every known type, with zeros.  For users see ``counts_closed_users``."""
    return closed_counts(table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 16), "bucket")


@query("""SELECT user_id, event_type, count(event_id) AS n FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT DISTINCT event_type FROM events) LEFT JOIN events USING (user_id, event_type) GROUP BY ALL""")
def counts_closed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and every known type, with zeros."""
    return closed_counts(table(spark, sf_dir, "events"), "user_id")


@query("""WITH x AS (SELECT o_custkey, p_type, min((o_orderdate, o_orderkey)) AS first, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT o_custkey, p_type, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first, p_type) AS r FROM x) WHERE r = 1""")
def mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's most frequent part type; of equals that ordered first."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li, p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "part").select("p_partkey", "p_type")
    x = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"]).groupBy("o_custkey", "p_type").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("first"), F.count("*").alias("n"))
    best = x.groupBy("o_custkey").agg(F.min(F.struct((-F.col("n")).alias("r"), F.col("first"), F.col("p_type"))).alias("b"))
    return best.select("o_custkey", F.col("b.p_type").alias("p_type"), (-F.col("b.r")).alias("n"))


@query("""SELECT o_custkey AS trip, CAST(l_shipdate AS DATE) AS day, l_partkey % 20 AS kind, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL HAVING count(*) > 1""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a trip that repeat in day and kind, a bucket of parts.  For parts see ``duplicate_parts``."""
    return items(spark, sf_dir).groupBy("trip", "day", (F.col("l_partkey") % 20).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("n_suppliers")).where("n > 1")


@query("""SELECT o_custkey AS trip, l_partkey % 20 AS kind, count(*) AS n, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_days FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL
HAVING count(*) > 1 AND count(DISTINCT CAST(l_shipdate AS DATE)) < count(*)""")
def duplicate_with_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by kind alone, without those whose days all differ.  For parts see ``duplicate_parts_with_repeats``."""
    g = items(spark, sf_dir).groupBy("trip", (F.col("l_partkey") % 20).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("day").alias("n_days"))
    return g.where("n > 1 and n_days < n")


@query("""SELECT o_custkey AS trip, CAST(l_shipdate AS DATE) AS day, l_partkey AS part, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL HAVING count(*) > 1""")
def duplicate_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a trip that repeat in day and part."""
    return items(spark, sf_dir).groupBy("trip", "day", F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("n_suppliers")).where("n > 1")


@query("""SELECT o_custkey AS trip, l_partkey AS part, count(*) AS n, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_days FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL
HAVING count(*) > 1 AND count(DISTINCT CAST(l_shipdate AS DATE)) < count(*)""")
def duplicate_parts_with_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by part alone, without those whose days all differ."""
    g = items(spark, sf_dir).groupBy("trip", F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"), F.count_distinct("day").alias("n_days"))
    return g.where("n > 1 and n_days < n")


@query("""SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user and type, by an aggregate that combines before the shuffle."""
    best = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return best.select("user_id", "event_type", F.col("m.event_id").alias("event_id"), F.round("m.value", 6).alias("value"))


@query("""SELECT l_orderkey, (max(l_linenumber) + 1)::BIGINT AS next_version, count(*) AS n FROM lineitem GROUP BY 1""")
def version_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max("l_linenumber") + 1).cast("bigint").alias("next_version"), F.count("*").alias("n"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality IS NULL) AS unlabelled,
  CASE WHEN count(*) FILTER (toxic = 1) > 0 THEN 'blocked' WHEN count(*) FILTER (quality = 0) > count(*) FILTER (quality = 1) THEN 'review' ELSE 'ready' END AS disposition
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id GROUP BY source""")
def quality_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    bad, good, toxic = F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1), F.count_if(F.col("toxic") == 1)
    g = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left").groupBy("source")
    return g.agg(F.count("*").alias("n"), good.alias("good"), toxic.alias("toxic"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.when(toxic > 0, "blocked").when(bad > good, "review").otherwise("ready").alias("disposition"))


@query("""SELECT source, quantile_disc(n_chars, 0.5)::BIGINT AS p50, quantile_disc(n_chars, 0.95)::BIGINT AS p95, max(n_chars) AS largest FROM documents GROUP BY source""")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("source")
    return g.agg(F.expr("percentile_disc(0.5) within group (order by n_chars)").cast("bigint").alias("p50"), F.expr("percentile_disc(0.95) within group (order by n_chars)").cast("bigint").alias("p95"), F.max("n_chars").alias("largest"))


_MINUTES = "CASE l_returnflag WHEN 'A' THEN 540 WHEN 'N' THEN 720 ELSE 900 END"


@query(f"""WITH x AS (SELECT o_custkey AS trip, CAST(l_shipdate AS DATE) AS day, {_MINUTES} AS minutes, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS kind, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT trip, day, row_number() OVER (PARTITION BY trip, day ORDER BY minutes, kind, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS place, minutes::INT AS minutes, l_partkey FROM x""")
def day_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's entries in order of time, kind and key; entries without a time have the default of theirs."""
    x = items(spark, sf_dir).withColumn("minutes", F.expr(_MINUTES)).withColumn("kind", F.expr("if(l_linestatus = 'F', 0, 1)"))
    w = W.partitionBy("trip", "day").orderBy("minutes", "kind", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return x.select("trip", "day", F.row_number().over(w).cast("bigint").alias("place"), F.col("minutes").cast("int").alias("minutes"), "l_partkey")


@query("""SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def nest_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its items in order; an order's items are few."""
    kids = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("k"))
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(kids, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.coalesce(F.array_join(F.transform("k", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ","), F.lit("")).alias("children"))


@query("""SELECT user_id, event_id, rank, CASE WHEN rank <= 5 THEN 'kept' ELSE 'over_budget' END AS outcome FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, value DESC, event_id) AS rank FROM events)""")
def topk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events by class and value; the first five are within the budget."""
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.expr("case event_type when 'purchase' then 0 when 'error' then 1 else 2 end"), F.desc("value"), "event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", rank.cast("bigint").alias("rank")).withColumn("outcome", F.expr("if(rank <= 5, 'kept', 'over_budget')"))


@query("""SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def ext_rollup_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition of ours: revenue by region and nation with subtotals.  Items are summed by supplier first."""
    price = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(24,6)")
    by = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(price).alias("revenue"))
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    x = by.join(s, by["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return x.rollup("r_name", "n_name").agg(F.sum("n").alias("n"), F.round(F.sum("revenue").cast("double"), 2).alias("revenue"))
