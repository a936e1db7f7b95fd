"""Range, as-of and overlap joins over trips' dated records.  All are equi-joins on the trip first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import partitions, staged
from ..plans.trips import ITEMS_SQL, LEGS_SQL, STAYS_SQL, items, legs, stays
from ..registry import query
from ..sources.tables import table

#: Days of a stretch, in which days and stays are brought together.
STRETCH = 32


@query(f"""WITH {LEGS_SQL}, {ITEMS_SQL}, d AS (SELECT trip, day, count(*) AS n FROM items GROUP BY ALL),
m AS (SELECT d.trip, d.day, d.n, min(CASE WHEN arrive <= day AND day < leave THEN (0, arrive, leg) WHEN arrive = day THEN (1, arrive, leg) END) AS best FROM d LEFT JOIN legs ON legs.trip = d.trip GROUP BY ALL)
SELECT best[3] AS leg, sum(n)::BIGINT AS n_items FROM m GROUP BY ALL""")
def interval_leg_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by leg: that with arrive <= day < leave, else that which begins on the day, else none.
    A window over a trip's days; items and legs are combined by day first, so a trip is no larger than its calendar."""
    d = items(spark, sf_dir).groupBy("trip", F.col("day").alias("at")).agg(F.count("*").alias("n"))
    # legs follow each other, so of those that begin on one day one at most is longer, and of all days only the last that has begun matters
    longer = F.min(F.when(F.col("arrive") < F.col("leave"), F.struct("leg", "leave")))
    begun = legs(spark, sf_dir).groupBy("trip", F.col("arrive").alias("at")).agg(F.struct(longer.alias("longer"), F.min("leg").alias("first")).alias("legs"))
    begun = begun.withColumn("legs", F.struct("at", "legs.*"))
    both = d.withColumn("legs", F.lit(None).cast(begun.schema["legs"].dataType)).unionByName(begun.withColumn("n", F.lit(None).cast("bigint")))
    w = W.partitionBy("trip").orderBy("at").rangeBetween(W.unboundedPreceding, 0)
    found = both.withColumn("legs", F.last("legs", ignorenulls=True).over(w)).where("n is not null")
    leg = F.when(F.col("at") < F.col("legs.longer.leave"), F.col("legs.longer.leg")).when(F.col("at") == F.col("legs.at"), F.col("legs.first"))
    return found.groupBy(leg.alias("leg")).agg(F.sum("n").alias("n_items"))


@query(f"""WITH {LEGS_SQL}, {ITEMS_SQL}, d AS (SELECT trip, day, count(*) AS n FROM items GROUP BY ALL),
m AS (SELECT d.trip, d.day, d.n, max((arrive, leg)) AS best FROM d LEFT JOIN legs ON legs.trip = d.trip AND arrive <= day GROUP BY ALL)
SELECT best[2] AS leg, sum(n)::BIGINT AS n_items FROM m GROUP BY ALL""")
def interval_asof_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by the latest leg that has begun (of equal days the larger key): one sort by trip, no join."""
    d = items(spark, sf_dir).groupBy("trip", F.col("day").alias("at")).agg(F.count("*").alias("n")).select("trip", "at", F.lit(None).cast("bigint").alias("leg"), "n")
    both = d.unionByName(legs(spark, sf_dir).select("trip", F.col("arrive").alias("at"), "leg", F.lit(None).cast("bigint").alias("n")))
    w = W.partitionBy("trip").orderBy("at", F.col("leg").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("leg", F.last("leg", ignorenulls=True).over(w)).where("n is not null")
    return found.groupBy("leg").agg(F.sum("n").alias("n_items"))


@query(f"""WITH {STAYS_SQL} SELECT trip, count(DISTINCT day) AS n_days, min(day)::DATE AS first_day, max(day)::DATE AS last_day
FROM (SELECT trip, unnest(range(check_in, greatest(check_out, CAST(check_in + INTERVAL 1 DAY AS DATE)), INTERVAL 1 DAY)) AS day FROM stays) GROUP BY trip""")
def date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that a trip's stays cover, the last one open; one day at least.  In order of their first days, each stay adds what lies
    behind all that came before.  Stays that begin on one day are combined first, so a trip is no larger than its calendar."""
    end = F.greatest(F.col("check_out"), F.date_add("check_in", 1))
    s = stays(spark, sf_dir).groupBy("trip", "check_in").agg(F.max(end).alias("end"))
    reach = F.max("end").over(W.partitionBy("trip").orderBy("check_in").rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("days", F.greatest(F.datediff("end", F.greatest("check_in", reach)), F.lit(0)))
    return s.groupBy("trip").agg(F.sum("days").alias("n_days"), F.min("check_in").alias("first_day"), F.date_sub(F.max("end"), 1).alias("last_day"))


@query(f"""WITH {ITEMS_SQL}, s AS (SELECT o_custkey AS trip, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi, count(DISTINCT CAST(o_orderdate AS DATE)) AS n FROM orders GROUP BY o_custkey)
SELECT s.trip, n AS n_spine, count(*) FILTER (day < lo - CASE WHEN n = 1 THEN 90 ELSE 7 END OR day > hi + CASE WHEN n = 1 THEN 90 ELSE 7 END) AS n_outside, count(*) AS n_items FROM s JOIN items ON items.trip = s.trip GROUP BY ALL""")
def spine_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items outside the trip's range of order dates, with slack of 7 days, or 90 where there is one date."""
    day = F.to_date("o_orderdate")
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("trip")).agg(F.min(day).alias("lo"), F.max(day).alias("hi"), F.count_distinct(day).alias("n_spine"))
    slack = F.when(F.col("n_spine") == 1, 90).otherwise(7)
    outside = (F.col("day") < F.date_sub("lo", slack)) | (F.col("day") > F.date_add("hi", slack))
    return items(spark, sf_dir).join(s, "trip").groupBy("trip", "n_spine").agg(F.count_if(outside).alias("n_outside"), F.count("*").alias("n_items"))


@query("""WITH c AS (SELECT conv_id, turn, role, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
  min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS after FROM conversations)
SELECT conv_id, turn, CASE WHEN before IS NULL OR after - turn < turn - before THEN after ELSE before END AS nearest FROM c WHERE role = 'assistant'""")
def nearest_dated_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn of the assistant the nearest of the user; of two as near the earlier."""
    user = F.when(F.col("role") == "user", F.col("turn"))
    w = W.partitionBy("conv_id")
    before = F.max(user).over(w.orderBy("turn").rangeBetween(W.unboundedPreceding, 0))
    after = F.min(user).over(w.orderBy("turn").rangeBetween(0, W.unboundedFollowing))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", before.alias("before"), after.alias("after")).where("role = 'assistant'")
    return c.select("conv_id", "turn", F.expr("if(before is null or after - turn < turn - before, after, before)").alias("nearest"))


@query(f"""WITH {STAYS_SQL} SELECT a.trip, count(*) AS n_overlaps, sum(date_diff('day', greatest(a.check_in, b.check_in), least(a.check_out, b.check_out)))::BIGINT AS days
FROM stays a JOIN stays b ON a.trip = b.trip AND a.stay < b.stay AND a.check_in < b.check_out AND b.check_in < a.check_out GROUP BY a.trip""")
def interval_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a trip's stays that overlap for a day at least, counted without making them.  Of all pairs those go in which one
    ends by the other's begin; a stay that ends on its first day is apart from itself, and two such of one day from each other on both sides.
    Days shared are pairs of the stays of each day.  All from begins and ends by day, so a trip is no larger
    than its calendar.  A stay that ends before it begins is inside those around it, by fewer days than none."""
    all_ = stays(spark, sf_dir).groupBy("trip", "check_in", "check_out").agg(F.count("*").alias("n"))
    s = all_.where("check_in <= check_out")
    zero = F.lit(0).cast("bigint")
    ends = F.array(F.struct(F.col("check_in").alias("day"), F.col("n").alias("begin"), zero.alias("end")), F.struct(F.col("check_out").alias("day"), zero.alias("begin"), F.col("n").alias("end")))
    short = F.when(F.col("check_in") == F.col("check_out"), F.col("n")).otherwise(0)
    short = s.groupBy("trip").agg(F.sum(short).alias("short"), F.sum(short * (short - 1) / 2).cast("bigint").alias("short_pairs"))
    day = s.select("trip", F.explode(ends).alias("e")).groupBy("trip", "e.day").agg(F.sum("e.begin").alias("begin"), F.sum("e.end").alias("end"))
    w = W.partitionBy("trip").orderBy("day")
    day = day.select("trip", "begin", F.sum("begin").over(w).alias("begun"), F.sum("end").over(w).alias("ended"), F.datediff(F.lead("day").over(w), "day").alias("length"))
    there = F.col("begun") - F.col("ended")
    total = day.groupBy("trip").agg(F.sum("begin").alias("n"), F.sum(F.col("begin") * F.col("ended")).alias("apart"), F.sum(F.col("length") * there * (there - 1) / 2).cast("bigint").alias("days"))
    pairs = (F.col("n") * (F.col("n") - 1) / 2 - F.col("apart") + F.col("short") + F.col("short_pairs")).cast("bigint")
    swept = total.join(short, "trip").select("trip", pairs.alias("n_overlaps"), "days")
    # a stay that ends before it begins meets those that begin before its end and end behind its begin
    stretch = lambda c: F.floor(F.unix_date(c) / STRETCH)
    back = all_.where("check_in > check_out").select("trip", F.col("check_in").alias("i"), F.col("check_out").alias("o"), F.col("n").alias("m"), stretch("check_out").alias("stretch"))
    met = back.join(s.withColumn("stretch", F.explode(F.sequence(stretch("check_in"), stretch("check_out")))), ["trip", "stretch"]).where("check_in < o and i < check_out")
    met = met.groupBy("trip").agg(F.sum(F.col("n") * F.col("m")).alias("n_overlaps"), F.sum(F.col("n") * F.col("m") * F.datediff("o", "i")).alias("days"))
    return swept.union(met).groupBy("trip").agg(F.sum("n_overlaps").alias("n_overlaps"), F.sum("days").alias("days")).where("n_overlaps > 0")


@query(f"""WITH {ITEMS_SQL}, {STAYS_SQL}, d AS (SELECT trip, l_orderkey, day, count(*) AS n FROM items GROUP BY ALL),
m AS (SELECT d.trip, d.l_orderkey, d.day, d.n, min(stay) AS stay FROM d JOIN stays ON stays.trip = d.trip AND stay <> l_orderkey AND day BETWEEN check_in AND check_out GROUP BY ALL)
SELECT stay, sum(n)::BIGINT AS n_items FROM m GROUP BY stay""")
def stay_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that fall in another order's stay, both ends counted; the first stay takes them.  Days meet the stays of their
    stretch of ``STRETCH`` days only, and items their day's first stay, or if that is their own the second.  Lines are dealt out once by
    order, which gives items and stays, and all else has as many parts as lines call for."""
    n = partitions(table(spark, sf_dir, "lineitem"))
    all_ = items(spark, sf_dir, n, "o_orderdate").withColumn("check_in", F.to_date("o_orderdate")).groupBy("l_orderkey", "trip", "check_in", "day").agg(F.count("*").alias("n"))
    all_ = staged(all_, "items")
    stretch = lambda c: F.floor(F.unix_date(c) / STRETCH)
    s = all_.repartition(n, "l_orderkey").groupBy("l_orderkey", "trip", "check_in").agg(F.max("day").alias("check_out")).where("check_in <= check_out")
    s = s.select("trip", F.col("l_orderkey").alias("stay"), "check_in", "check_out", F.explode(F.sequence(stretch("check_in"), stretch("check_out"))).alias("stretch"))
    items_ = all_.where("day is not null").select("trip", "l_orderkey", "day", "n")
    days = items_.select("trip", "day", stretch("day").alias("stretch")).repartition(n, "trip", "stretch").distinct()
    held = days.join(s.repartition(n, "trip", "stretch"), ["trip", "stretch"]).where(F.col("day").between(F.col("check_in"), F.col("check_out"))).select("trip", "stretch", "day", "stay")
    two = held.withColumn("nth", F.dense_rank().over(W.partitionBy("trip", "stretch", "day").orderBy("stay"))).where("nth <= 2")
    two = two.groupBy("trip", "stretch", "day").agg(F.min("stay").alias("stay"), F.max("stay").alias("next"))
    met = items_.repartition(n, "trip", "day").join(two.select("trip", "day", "stay", "next").repartition(n, "trip", "day"), ["trip", "day"])
    met = met.select(F.when(F.col("stay") != F.col("l_orderkey"), F.col("stay")).otherwise(F.col("next")).alias("stay"), "l_orderkey", "n").where("stay != l_orderkey")
    return met.groupBy("stay").agg(F.sum("n").alias("n_items"))
