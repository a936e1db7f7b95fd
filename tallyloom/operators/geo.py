"""Coordinates: distances, radius joins by grid, view ports and routes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import staged
from ..registry import query
from ..sources.tables import table
from .resolve import connected

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, lat, lon: the first two dimensions, scaled."""
    e = table(spark, sf_dir, "embeddings")
    scaled = lambda i, m: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("embedding")[i].cast("double") * 2)) * m, 4)
    return e.select("vec_id", "label", scaled(0, 80.0).alias("lat"), scaled(1, 180.0).alias("lon"))


def radius_pairs(p: DataFrame, km: float, by: str) -> DataFrame:
    """Pairs of points of a group within ``km``: points meet in cells of the grid and its neighbours, so each
    compares with those nearby alone.  A row's cells are as wide as ``km`` may reach at the highest latitude of it and the rows
    beside it, which near a pole is all the way round; the grid wraps at the date line."""
    angle = km / EARTH_KM
    height = math.degrees(angle)

    def columns(row: Column) -> Column:
        high = F.least(F.greatest(F.abs((row - 1) * height), F.abs((row + 2) * height)), F.lit(90.0))
        reach = F.lit(math.sin(angle)) / F.cos(F.radians(high))
        return F.when((reach >= 1) | (high >= 90), 1).otherwise(F.greatest(F.floor(360 / F.degrees(F.asin(reach))), F.lit(1)))

    place = lambda lon, n: F.floor((lon + 180) / 360 * n)
    row = F.floor(F.col("lat") / height)
    a = p.select(F.col(by), F.col("vec_id").alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), row.alias("r"))
    a = a.withColumn("c", F.pmod(place(F.col("lon_a"), columns(F.col("r"))), columns(F.col("r"))))
    b = p.select(F.col(by), F.col("vec_id").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), F.explode(F.array(row - 1, row, row + 1)).alias("r"))
    b = b.withColumn("n", columns(F.col("r"))).withColumn("at", place(F.col("lon_b"), F.col("n")))
    b = b.withColumn("c", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("at") + d, F.col("n")) for d in (-1, 0, 1)])))).drop("at", "n")
    distance = haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return a.join(b, [by, "r", "c"]).where("a < b").withColumn("km", distance).where(F.col("km") <= km).select(by, "a", "b", "km")


_POINTS = """p AS (SELECT vec_id, label, round(greatest(-1.0, least(1.0, CAST(embedding[1] AS DOUBLE) * 2)) * 80, 4) AS lat, round(greatest(-1.0, least(1.0, CAST(embedding[2] AS DOUBLE) * 2)) * 180, 4) AS lon FROM embeddings)"""
_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"""WITH {_POINTS} SELECT a.label, a.vec_id AS a, b.vec_id AS b, round({_KM}, 3) AS km FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_KM} <= 300""")
def geo_pairs_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radius_pairs(points(spark, sf_dir), 300.0, "label").select("label", "a", "b", F.round("km", 3).alias("km"))


@query(f"""WITH {_POINTS} SELECT label, count(*) FILTER (lat BETWEEN -20 AND 20 AND lon BETWEEN -60 AND 60) AS plain, count(*) FILTER (lat BETWEEN -20 AND 20 AND (lon >= 150 OR lon <= -150)) AS across FROM p GROUP BY label""")
def viewport_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a view port, and in one that crosses the date line (west edge greater than east)."""
    inside = lambda west, east: F.col("lat").between(-20, 20) & (F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east))
    return points(spark, sf_dir).groupBy("label").agg(F.count_if(inside(-60, 60)).alias("plain"), F.count_if(inside(150, -150)).alias("across"))


#: Fixed value: how near in km entries of a block are.
BLOCK_KM = 2.0


def radius_components(entries: DataFrame, km: float = BLOCK_KM) -> DataFrame:
    """block, index and component (from 0) of entries (block, index, source_order, lat, lon): entries within ``km`` of each other are of
    one component, and so is all that they link to.

    An entry without coordinates is of the component of the nearest index that has some, of two as near the lower.  A block of one entry, or
    with coordinates at one entry alone, is one component; so is one of two components if they have one entry and three or more.  Components are
    numbered by the source order of their first entry.  Indexes are unique within a block; a null block has no components."""
    e = staged(entries.select("block", "index", "source_order", "lat", "lon", (F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("placed")).where("block is not null"), "entries")
    p = e.where("placed").select("block", F.col("index").alias("vec_id"), "lat", "lon")
    node = lambda c: F.struct("block", F.col(c).alias("index"))
    roots = connected(radius_pairs(p, km, "block").select(node("a").alias("a"), node("b").alias("b"))).select("node.block", F.col("node.index").alias("near"), F.col("root.index").alias("root"))
    before, after = W.partitionBy("block").orderBy("index").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("block").orderBy("index").rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col("placed"), F.col("index"))
    e = e.withColumn("low", F.last(at, ignorenulls=True).over(before)).withColumn("high", F.first(at, ignorenulls=True).over(after))
    near = F.when(F.col("high").isNull() | (F.col("index") - F.col("low") <= F.col("high") - F.col("index")), F.col("low")).otherwise(F.col("high"))
    e = e.withColumn("near", near).join(roots, ["block", "near"], "left").withColumn("root", F.coalesce("root", "near"))
    parts = e.groupBy("block", "root").agg(F.count("*").alias("n"), F.count_if("placed").alias("n_placed"), F.min(F.struct("index", "source_order")).alias("first"))
    whole = parts.groupBy("block").agg(F.count("*").alias("n_parts"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n_placed").alias("with"))
    one = (F.col("with") < 2) | ((F.col("n_parts") == 2) & (F.col("least") == 1) & (F.col("most") >= 3))
    place = F.row_number().over(W.partitionBy("block").orderBy("first.source_order", "first.index")) - 1
    ranked = parts.withColumn("place", place).join(whole.select("block", one.alias("one")), "block").select("block", "root", F.when(F.col("one"), 0).otherwise(F.col("place")).alias("component"))
    return e.join(ranked.withColumnRenamed("root", "of"), "block").where(F.col("root").eqNullSafe(F.col("of"))).select("block", "index", "component")


_BLOCKS = f"""{_POINTS}, q AS MATERIALIZED (SELECT vec_id, label, CASE WHEN vec_id % 7 <> 0 THEN lat END AS lat, CASE WHEN vec_id % 7 <> 0 THEN lon END AS lon FROM p)"""


@query(f"""WITH RECURSIVE {_BLOCKS}, pl AS (SELECT * FROM q WHERE lat IS NOT NULL), ed AS MATERIALIZED (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM pl a JOIN pl b ON a.label = b.label AND a.vec_id <> b.vec_id AND {_KM} <= 700),
r(label, node, root) AS (SELECT label, vec_id, vec_id FROM pl UNION SELECT r.label, ed.b, r.root FROM r JOIN ed ON ed.label = r.label AND ed.a = r.node), c AS (SELECT label, node, min(root) AS root FROM r GROUP BY label, node),
n AS (SELECT q.label, q.vec_id, arg_min(c.root, (abs(c.node - q.vec_id), c.node)) AS root FROM q JOIN c USING (label) GROUP BY q.label, q.vec_id),
s AS (SELECT label, root, count(*) AS k, min(vec_id) AS first FROM n GROUP BY label, root), w AS (SELECT label, count(*) AS parts, min(k) AS lo, max(k) AS hi FROM s GROUP BY label)
SELECT n.label, n.vec_id, CAST(CASE WHEN parts = 2 AND lo = 1 AND hi >= 3 THEN 0 ELSE place END AS INTEGER) AS component
FROM n JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY first) - 1 AS place FROM s) s USING (label, root) JOIN w USING (label)""")
def radius_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components within 700 km of the points of a label; every seventh point has no coordinates and goes with its neighbour."""
    placed = F.col("vec_id") % 7 != 0
    e = points(spark, sf_dir).select(F.col("label").alias("block"), F.col("vec_id").alias("index"), F.col("vec_id").alias("source_order"), F.when(placed, F.col("lat")).alias("lat"), F.when(placed, F.col("lon")).alias("lon"))
    return radius_components(e, 700.0).select(F.col("block").alias("label"), F.col("index").alias("vec_id"), "component")
