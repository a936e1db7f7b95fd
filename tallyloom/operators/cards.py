"""What a card shows: times that are inferred, dates as people read them, segments of headings, coordinates and colours it may use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.trips import ITEMS_SQL, items
from ..registry import query
from ..sources.tables import table
from .geo import _POINTS, points

#: Words that tell when an activity takes place, with its minutes; what is done on arrival.
HOURS = [
    ("breakfast|bakery|coffee|cafe|brunch", 9 * 60),
    ("lunch|market", 12 * 60),
    ("dinner|restaurant|supper", 19 * 60),
    ("bar|pub|cocktail|beer|wine|nightlife|club|music", 21 * 60),
    ("museum|palace|cathedral|church|synagogue|gallery|park|garden|castle|tour|walk|sightseeing|shopping|shop", 13 * 60),
]
OTHER_HOUR = 15 * 60
ON_ARRIVAL = r"\b(?:pick up|pickup|collect).{0,24}\b(?:card|pass|key)\b"
#: Months; separators of a heading's segments.
MONTHS = "January February March April May June July August September October November December".split()
SEGMENT = r"//|\s+[—–]\s+|::|\s+-{2,}\s+|/|\||•|·"


def inferred_minutes(explicit: Column, text: Column, arrival: Column) -> Column:
    """Minutes of the day of an activity: its own, else those of the first kind of words its normal text has; a quarter of an hour
    after arrival at the earliest, and what is done on arrival a minute after it."""
    base = F.when(explicit.isNotNull(), explicit)
    for words, minutes in HOURS:
        base = base.when(text.rlike(rf"\b({words})\b"), minutes)
    base = base.otherwise(OTHER_HOUR)
    return F.when(arrival.isNull(), base).when(text.rlike(ON_ARRIVAL), arrival + 1).otherwise(F.greatest(base, arrival + 15))


_TITLES = ["Breakfast at the bakery", "Lunch & market", "Dinner", "Wine bar", "Castle tour", "Pick up the city card", "Taxi", "Barbican, late"]
_TITLES_SQL = "[" + ", ".join(f"'{t}'" for t in _TITLES) + "]"
_HOURS_SQL = " ".join(f"WHEN regexp_matches(t, '\\b({w})\\b') THEN {m}" for w, m in HOURS)


@query(f"""WITH {ITEMS_SQL}, a AS (SELECT l_orderkey, max(CAST(600 + l_quantity * 10 AS INT)) AS arrival FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
x AS (SELECT CASE WHEN l_quantity < 5 THEN l_linenumber * 60 + 510 END AS own, trim(regexp_replace(replace(lower({_TITLES_SQL}[1 + l_partkey % {len(_TITLES)}]), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS t, arrival FROM lineitem LEFT JOIN a USING (l_orderkey)),
b AS (SELECT *, CASE WHEN own IS NOT NULL THEN own {_HOURS_SQL} ELSE {OTHER_HOUR} END AS base FROM x)
SELECT CASE WHEN arrival IS NULL THEN base WHEN regexp_matches(t, '{ON_ARRIVAL}') THEN arrival + 1 ELSE greatest(base, arrival + 15) END AS minutes, count(*) AS n FROM b GROUP BY 1""")
def card_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by the minute of the day they are shown at.  The latest arrival of an order is one row before items meet it."""
    li = table(spark, sf_dir, "lineitem")
    arrival = li.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max((600 + F.col("l_quantity") * 10).cast("int")).alias("arrival"))
    title = F.element_at(F.array(*[F.lit(t) for t in _TITLES]), (1 + F.col("l_partkey") % len(_TITLES)).cast("int"))
    own = F.when(F.col("l_quantity") < 5, F.col("l_linenumber") * 60 + 510)
    x = li.join(arrival, "l_orderkey", "left").select(inferred_minutes(own, T.normalize(title), F.col("arrival")).alias("minutes"))
    return x.groupBy("minutes").agg(F.count("*").alias("n"))


def _each(c: Column, pattern: str, new) -> Column:
    """``c`` with every match of the pattern turned by ``new``: what stands between matches, and the matches, in turn."""
    parts = F.arrays_zip(F.split(c, pattern, -1).alias("gap"), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("m"))
    return F.array_join(F.transform(parts, lambda x: F.concat(x["gap"], F.coalesce(new(x["m"]), F.lit("")))), "")


def readable_dates(c: Column) -> Column:
    """``20190113`` and ``2019-01-13`` in prose as ``January 13th, 2019``; what is no day of the calendar is left as digits."""

    def readable(m: Column) -> Column:
        digits = F.replace(m, F.lit("-"), F.lit(""))
        day = F.substring(digits, 7, 2).cast("int")
        suffix = F.when((day % 100).between(11, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
        month = F.element_at(F.array(*[F.lit(x) for x in MONTHS]), F.substring(digits, 5, 2).cast("int"))
        valid = F.try_to_date(digits, "yyyyMMdd").isNotNull()
        return F.when(m.isNull(), None).when(valid, F.concat(month, F.lit(" "), day.cast("string"), suffix, F.lit(", "), F.substring(digits, 1, 4))).otherwise(digits)

    return _each(_each(c, r"\b\d{8}\b", readable), r"\b\d{4}-\d{2}-\d{2}\b", readable)


@query("""WITH r AS (SELECT o_orderkey, 'Arrive ' || strftime(o_orderdate, '%Y%m%d') || ', not ' || strftime(o_orderdate, '%Y') || '13' || lpad(CAST(o_orderkey % 90 AS VARCHAR), 2, '0') || '; leave ' || strftime(o_orderdate, '%Y-%m-%d') || '.' AS raw, o_orderdate AS d FROM orders),
s AS (SELECT *, CASE WHEN day(d) BETWEEN 11 AND 13 THEN 'th' WHEN day(d) % 10 = 1 THEN 'st' WHEN day(d) % 10 = 2 THEN 'nd' WHEN day(d) % 10 = 3 THEN 'rd' ELSE 'th' END AS suffix FROM r),
t AS (SELECT *, strftime(d, '%B ') || day(d) || suffix || ', ' || year(d) AS nice FROM s)
SELECT o_orderkey, 'Arrive ' || nice || ', not ' || strftime(d, '%Y') || '13' || lpad(CAST(o_orderkey % 90 AS VARCHAR), 2, '0') || '; leave ' || nice || '.' AS shown FROM t""")
def card_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with two dates and what is none, as people read them."""
    day = lambda p: F.date_format("o_orderdate", p)
    raw = F.concat(F.lit("Arrive "), day("yyyyMMdd"), F.lit(", not "), day("yyyy"), F.lit("13"), F.lpad((F.col("o_orderkey") % 90).cast("string"), 2, "0"), F.lit("; leave "), day("yyyy-MM-dd"), F.lit("."))
    return table(spark, sf_dir, "orders").select("o_orderkey", readable_dates(raw).alias("shown"))


def heading_segments(c: Column) -> Column:
    """Parts of a heading between its separators, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, SEGMENT), lambda x: F.trim(x)), lambda x: x != "")


@query(f"""SELECT p_partkey, CAST(len(s) AS BIGINT) AS n_segments, array_to_string(s, '|') AS segments FROM (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(p_brand || ' // ' || p_type || ' — ' || CASE WHEN p_size % 2 = 0 THEN '' ELSE 'a/b' END || ' -- ' || p_name || '::' || p_size, '{SEGMENT}'), lambda x: trim(x)), lambda x: x <> '') AS s FROM part)""")
def card_heading_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_brand", F.lit(" // "), "p_type", F.lit(" — "), F.when(F.col("p_size") % 2 == 0, "").otherwise("a/b"), F.lit(" -- "), "p_name", F.lit("::"), F.col("p_size").cast("string"))
    p = table(spark, sf_dir, "part").select("p_partkey", heading_segments(raw).alias("s"))
    return p.select("p_partkey", F.size("s").cast("bigint").alias("n_segments"), F.array_join("s", "|").alias("segments"))


def decimals(c: Column) -> Column:
    """Digits behind the point of a number as it is written."""
    return F.length(F.regexp_replace(F.regexp_replace(c.cast("decimal(20,10)").cast("string"), r"^[^.]*\.", ""), "0+$", ""))


@query(f"""WITH {_POINTS}, d AS (SELECT label, lat, lon, length(regexp_replace(regexp_replace(CAST(CAST(lat AS DECIMAL(20,10)) AS VARCHAR), '^[^.]*\\.', ''), '0+$', '')) AS a, length(regexp_replace(regexp_replace(CAST(CAST(lon AS DECIMAL(20,10)) AS VARCHAR), '^[^.]*\\.', ''), '0+$', '')) AS b FROM p)
SELECT label, count(*) AS n, count(*) FILTER (NOT (lat = 0 AND lon = 0) AND (a >= 3 OR b >= 3)) AS n_precise FROM d GROUP BY label""")
def card_precise_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points precise enough to show: not (0, 0), and three digits behind the point on either axis."""
    precise = ~((F.col("lat") == 0) & (F.col("lon") == 0)) & ((decimals(F.col("lat")) >= 3) | (decimals(F.col("lon")) >= 3))
    return points(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_if(precise).alias("n_precise"))


@query(f"""WITH {_POINTS}, v AS (SELECT label, bool_or(vec_id % 7 = 0 AND label % 2 = 0) AS ran FROM p GROUP BY 1)
SELECT vec_id, CASE WHEN vec_id % 7 = 0 AND label % 2 = 0 THEN 'verified' WHEN ran THEN 'none' ELSE 'approximate' END AS shown FROM p JOIN v USING (label)""")
def card_coordinate_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified coordinates first; once a trip's have been verified at all, approximate ones are refused."""
    p = points(spark, sf_dir).withColumn("verified", (F.col("vec_id") % 7 == 0) & (F.col("label") % 2 == 0))
    ran = p.groupBy("label").agg(F.bool_or("verified").alias("ran"))
    return p.join(ran, "label").select("vec_id", F.when(F.col("verified"), "verified").when(F.col("ran"), "none").otherwise("approximate").alias("shown"))


@query(r"""WITH y AS (SELECT doc_id, source, regexp_extract(text, '\b((?:19|20)[0-9]{2})[-/.][0-9]{1,2}[-/.][0-9]{1,2}\b', 1) AS year FROM documents)
SELECT source, CAST(arg_min(year, doc_id) AS INT) AS default_year, count(*) AS n_dated FROM y WHERE year <> '' GROUP BY source""")
def default_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year of each source's first dated document."""
    year = F.regexp_extract("text", r"\b((?:19|20)[0-9]{2})[-/.][0-9]{1,2}[-/.][0-9]{1,2}\b", 1)
    y = table(spark, sf_dir, "documents").select("doc_id", "source", year.alias("year")).where("year != ''")
    return y.groupBy("source").agg(F.min_by("year", "doc_id").cast("int").alias("default_year"), F.count("*").alias("n_dated"))


@query("""SELECT c_custkey, sha256(to_json({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment, 'c_name': c_name, 'c_nationkey': CASE WHEN c_nationkey > 12 THEN c_nationkey END})::VARCHAR) AS stable_hash FROM customer""")
def stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each record as JSON with its keys in order and nulls kept."""
    c = table(spark, sf_dir, "customer").withColumn("c_nationkey", F.when(F.col("c_nationkey") > 12, F.col("c_nationkey")))
    return c.select("c_custkey", F.sha2(F.to_json(F.struct("c_custkey", "c_mktsegment", "c_name", "c_nationkey"), {"ignoreNullFields": "false"}), 256).alias("stable_hash"))


#: A payload of so many bytes is refused.
PAYLOAD_BYTES = 1 << 20


@query(f"""SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, strlen(coalesce(text, '')) < {PAYLOAD_BYTES} AS accepted FROM documents""")
def size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as payloads, with whether their bytes are few enough."""
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_bytes"), (n < PAYLOAD_BYTES).alias("accepted"))


@query("""SELECT user_id, props, CAST(ts AS DATE) AS day, max_by(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2, 3""")
def reusable_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last completed batch for each combination of what a new one would have."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.groupBy("user_id", "props", F.to_date("ts").alias("day")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))


@query("""SELECT l_orderkey, string_agg(DISTINCT CASE WHEN l_returnflag = 'R' THEN 'travel' ELSE 'supplier' END || ':' || l_suppkey, ',' ORDER BY CASE WHEN l_returnflag = 'R' THEN 'travel' ELSE 'supplier' END || ':' || l_suppkey) AS details FROM lineitem GROUP BY 1""")
def subject_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's private details, once each: its suppliers, and under another name those of travel."""
    detail = F.concat_ws(":", F.when(F.col("l_returnflag") == "R", "travel").otherwise("supplier"), F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(detail)), ",").alias("details"))


@query(f"""WITH {ITEMS_SQL} SELECT trip, count(*) AS n_all, count(*) FILTER (l_linestatus <> 'F') AS n_active, count(*) FILTER (l_linestatus <> 'F' AND l_linenumber = 1) AS n_top, count(*) FILTER (l_linestatus <> 'F' AND l_linenumber = 1 AND l_returnflag <> 'N') AS n_cards FROM items GROUP BY trip""")
def active_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each trip that are not ignored, those with no parent, and of these the cards: no notes or placeholders."""
    active, top, card = F.col("l_linestatus") != "F", F.col("l_linenumber") == 1, F.col("l_returnflag") != "N"
    return items(spark, sf_dir).groupBy("trip").agg(F.count("*").alias("n_all"), F.count_if(active).alias("n_active"), F.count_if(active & top).alias("n_top"), F.count_if(active & top & card).alias("n_cards"))


@query("""WITH h AS (SELECT p_partkey, '#' || lpad(lower(to_hex(p_partkey * 7919 % 16777216)), 6, '0') AS hex FROM part),
c AS (SELECT p_partkey, hex, CAST('0x' || hex[2:3] AS INT) AS r, CAST('0x' || hex[4:5] AS INT) AS g, CAST('0x' || hex[6:7] AS INT) AS b FROM h)
SELECT p_partkey, hex, r, g, b, 299 * r + 587 * g + 114 * b < 128000 AS dark FROM c""")
def card_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex colours as their parts, and whether light text reads on them."""
    h = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_partkey") * 7919 % 16777216)), 6, "0")).alias("hex"))
    part = lambda at: F.conv(F.substring("hex", at, 2), 16, 10).cast("int")
    c = h.select("p_partkey", "hex", part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))
    return c.withColumn("dark", F.expr("299 * r + 587 * g + 114 * b < 128000"))
