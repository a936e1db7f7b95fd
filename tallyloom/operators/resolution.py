"""Candidate windows: which candidates of a trip must be looked at together, and whether any must."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.staging import bucketed, partitions, staged
from ..registry import query
from ..sources.tables import table

#: Candidates of a window, windows of a trip, and what makes a day crowded.
MEMBERS, WINDOWS, CROWDED, FIXED = 24, 30, 8, 2
PROPOSAL, CITY_NOTE, CITY_REFERENCE = "grouping_proposal", "city_note_candidate", "city_reference"
def _seq() -> Column:
    """The order of candidates."""
    return F.struct("stage", "item", "candidate")


def _ready(candidates: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    candidates = candidates.withColumn("__city", T.normalize(F.col("city")))
    city = F.col("__city")
    labels = F.filter(F.array_distinct(F.transform(F.coalesce("labels", F.array().cast("array<string>")), T.normalize)), lambda x: x != "")
    return candidates.select(
        "block", "candidate", text("identity").alias("identity"), text("date").alias("date"), F.when(city == "", "unknown-city").otherwise(city).alias("city"), (text("city") != "").alias("placed"), T.normalize(F.col("title")).alias("title"), text("role").alias("role"), text("section_type").alias("section_type"),
        *[flag(c) for c in ("has_time", "has_booking", "has_plan", "has_recommendation")], "stage", "item", _seq().alias("seq"), F.coalesce("blocks", F.array().cast("array<string>")).alias("blocks"), labels.alias("labels"),
    )


def _first(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """The n first candidates of each key; what a window can't show is dropped before anything is joined."""
    return df.withColumn("__at", F.row_number().over(W.partitionBy(*key).orderBy("seq"))).where(F.col("__at") <= n).drop("__at")


def proposal_members(c: DataFrame, most: int, n: int) -> DataFrame:
    """block, key, first, candidate, seq, place of proposals' windows: the proposal, then candidates of its source in its scope.  c is in n buckets of block.

    In scope are candidates that share a source block, a label or the day, unless their days or cities are both given and differ.  All of
    a group with one day and city are in scope or none, so a group's first candidates are all that a window can take of it."""
    home = ["block", "identity"]
    p = c.where(F.col("role") == PROPOSAL).select(*home, F.col("candidate").alias("key"), F.col("seq").alias("first"), F.col("date").alias("p_date"), F.col("city").alias("p_city"), F.col("placed").alias("p_placed"), "blocks", "labels")
    scope = ((F.col("p_date") == "") | (F.col("date") == "") | (F.col("p_date") == F.col("date"))) & (~F.col("p_placed") | ~F.col("placed") | (F.col("p_city") == F.col("city"))) & (F.col("key") != F.col("candidate"))
    keep = [*home, "seq", "date", "city", "placed", "role"]
    group = ["date", "city", "placed"]

    def asked(df: DataFrame) -> DataFrame:
        """The first of each group that some proposal of the source may take from; windows, as rows lie by block."""
        there = df.withColumn("__asked", F.max((F.col("role") == PROPOSAL).cast("int")).over(W.partitionBy(*home, "of"))).where("__asked = 1")
        return _first(there.drop("__asked", "role"), [*home, "of", *group], most + 1).withColumn("candidate", F.col("seq.candidate"))

    dated = asked(c.where("date != ''").select(*keep, F.col("date").alias("of")))
    found = [p.where("p_date != ''").withColumn("of", F.col("p_date")).join(dated, [*home, "of"]).drop("of")]
    for many in ("blocks", "labels"):
        of = asked(c.select(*keep, F.explode(F.array_distinct(many)).alias("of")))
        found.append(p.withColumn("of", F.explode(F.array_distinct(many))).join(of, [*home, "of"]).drop("of"))
    shown = ["block", "key", "first", "candidate", "seq"]
    others = reduce(DataFrame.union, [f.where(scope).select(*shown) for f in found]).repartition(n, "block").distinct().withColumn("place", F.lit(1))
    itself = p.select("block", "key", "first", F.col("key").alias("candidate"), F.col("first").alias("seq"), F.lit(0).alias("place"))
    return others.union(itself)


def windows(candidates: DataFrame, most: int = MEMBERS, total: int = WINDOWS, n: int | None = None, made: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """block, place (from 1), family, key and members (in order) of each trip's windows.

    Candidates have block, candidate, identity, date, city, title, role, section_type, has_time, has_booking, has_plan, has_recommendation, stage,
    item, blocks and labels.  Families, in order: a grouping proposal with its scope; a day and city of a source with a candidate whose role is
    open (of a city's reference or notes, a recommendation, or loose on a crowded day); two of a day and city that share a source block; a title
    on two days.  A window shows its first 24 (the rule's own), windows of the same members are one, and a trip has its first 30.
    Candidate ids are unique within a block and not null; other nulls are empty.  Candidates are dealt out by block once, in n buckets; they may be
    narrow rows with a block, of which ``made`` makes the columns above where they then lie."""
    n = n or partitions(candidates)
    c = bucketed(candidates, ["block"], n, "candidates", lambda d: _ready(made(d)).drop("seq")).withColumn("seq", _seq())
    day = ["block", "identity", "date", "city"]
    name = F.concat_ws("|", "identity", F.when(F.col("date") == "", "undated").otherwise(F.col("date")), "city")
    rows = []

    def add(family: int, df: DataFrame, place: Column = F.lit(0)) -> None:
        rows.append(df.select("block", F.lit(family).alias("family"), "key", "first", "candidate", "seq", place.alias("place")))

    add(1, proposal_members(c, most, n), F.col("place"))

    loose = ~F.col("has_time") & ~F.col("has_booking") & ~F.col("has_plan")
    fixed = F.col("has_time") | F.col("has_booking") | F.col("has_plan")
    open_ = (F.col("section_type") == CITY_REFERENCE) | (F.col("role") == CITY_NOTE) | F.col("has_recommendation")
    # what a group is worth goes to its rows by windows: these need no shuffle where rows lie by block
    of_day, least = W.partitionBy(*day), lambda when: F.min(F.when(when, F.col("seq")))
    days = c.select(*day, "candidate", "seq", F.count("*").over(of_day).alias("n"), F.count_if(fixed).over(of_day).alias("n_fixed"), least(open_).over(of_day).alias("open"), least(loose).over(of_day).alias("loose"))
    crowded = F.when((F.col("n") >= CROWDED) & (F.col("n_fixed") >= FIXED), F.col("loose"))
    role = days.withColumn("first", F.array_min(F.array_compact(F.array("open", crowded)))).where("first is not null")
    add(2, _first(role, day, most).withColumn("key", name))

    solid = c.where((F.col("role") != PROPOSAL) & (F.col("section_type") != CITY_REFERENCE)).select(*day, "candidate", "seq", F.posexplode("blocks").alias("pos", "of"))
    of_part = W.partitionBy(*day, "of")
    shared = solid.withColumn("n", F.count("*").over(of_part)).withColumn("at", F.min(F.struct("seq", "pos")).over(of_part)).where("n > 1 and of is not null")
    own = _first(shared.groupBy(*day, "of", "candidate").agg(F.min("seq").alias("seq"), F.min("at").alias("at")), [*day, "of"], most)
    third = own.withColumn("key", F.concat_ws("|", name, "of"))
    rows.append(third.select("block", F.lit(3).alias("family"), "key", F.col("at.seq").alias("first"), "candidate", "seq", F.lit(0).alias("place"), F.col("at.pos").alias("pos")))

    titled = ["block", "identity", "title"]
    of_title = W.partitionBy(*titled)
    twice = c.select(*titled, "candidate", "seq", F.min("date").over(of_title).alias("lo"), F.max("date").over(of_title).alias("hi"), F.min("seq").over(of_title).alias("first")).where("lo < hi")
    add(4, _first(twice, titled, most).withColumn("key", F.concat_ws("|", "identity", "title")))

    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).withColumn("pos", F.coalesce("pos", F.lit(0)))
    window = ["block", "family", "key", "first", "pos"]
    shown = whole.withColumn("at", F.row_number().over(W.partitionBy(*window).orderBy("place", "seq"))).where(F.col("at") <= most)
    made = shown.groupBy(*window).agg(F.array_sort(F.collect_list(F.struct("at", "candidate")))["candidate"].alias("members"))
    made = made.withColumn("digest", F.sha2(F.to_json(F.array_sort("members")), 256))
    once = made.groupBy("block", "digest").agg(F.min(F.struct("family", "first", "pos", "key", "members")).alias("w")).select("block", "w.*")
    place = F.row_number().over(W.partitionBy("block").orderBy("family", "first", "pos", "key"))
    return once.withColumn("place", place).where(F.col("place") <= total).select("block", "place", "family", "key", "members")


def ambiguous(candidates: DataFrame) -> DataFrame:
    """block and ambiguous: does a trip have a grouping proposal, two candidates of a stage, day and city, or a title on two days?"""
    c = _ready(candidates).withColumn("city", F.when(F.col("city") == "unknown-city", "").otherwise(F.col("city")))
    by_day = c.groupBy("block", "stage", "date", "city").agg(F.max(F.col("role") == PROPOSAL).alias("p"), F.count("*").alias("n")).select("block", (F.col("p") | (F.col("n") > 1)).alias("is"))
    by_title = c.groupBy("block", "title").agg(F.count_distinct("date").alias("n")).select("block", (F.col("n") > 1).alias("is"))
    return by_day.union(by_title).groupBy("block").agg(F.max("is").alias("ambiguous"))


# --- on the driver's tables ---------------------------------------------------------------------------------

_ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
_CANDIDATES_SQL = f"""c AS MATERIALIZED (SELECT DISTINCT ON (o_custkey, {_ID}) o_custkey AS block, {_ID} AS candidate, o_orderpriority AS identity, year(l_shipdate) || '-' || quarter(l_shipdate) AS date, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS city, lower(p_brand) AS title,
  l_quantity >= 46 AS proposal, l_discount >= 0.09 AS note, l_tax >= 0.08 AS reference, l_tax > 0.04 AS has_time, l_returnflag = 'R' AS has_booking, l_linestatus = 'O' AS has_plan, l_discount < 0.01 AS has_rec, l_orderkey AS stage, l_linenumber AS item, 's' || l_suppkey AS src, lower(p_type) AS label
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey
  ORDER BY o_custkey, {_ID}, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"""


#: Keys of a line item; what a candidate's row says of it by yes or no, in this order, as one number.
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_FLAGS = ["proposal", "note", "reference", "has_time", "has_booking", "has_plan", "has_recommendation"]


def trip_lines(spark: SparkSession, sf_dir: str, n: int, hold: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """A customer's line items in narrow rows, of which ``as_candidates`` makes candidates: these are what is dealt out.  ``hold`` may
    write them before and after suppliers and parts are joined, so that what was shuffled until then need not stay."""
    by = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    # repeated line items go while they lie by order
    li = table(spark, sf_dir, "lineitem").repartition(n, "l_orderkey").groupBy(*_KEYS).agg(F.min(F.struct(*by)).alias("by")).select(*_KEYS, "by.*")
    o = table(spark, sf_dir, "orders").repartition(n, "o_orderkey").groupBy(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("block")).agg(F.min("o_orderpriority").alias("identity"))
    is_ = [F.col("l_quantity") >= 46, F.col("l_discount") >= 0.09, F.col("l_tax") >= 0.08, F.col("l_tax") > 0.04, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_discount") < 0.01]
    flags = reduce(Column.__add__, [F.when(x, 1 << i).otherwise(0) for i, x in enumerate(is_)])
    made = li.join(o, "l_orderkey").select("block", *_KEYS, "identity", (F.year("l_shipdate") * 10 + F.quarter("l_shipdate")).alias("quarter"), flags.alias("flags"))
    made = hold(made)
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("s_suppkey").alias("l_suppkey")).agg(F.min("n_name").alias("city"))
    p = table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.min(F.struct("p_brand", "p_type")).alias("p"))
    return hold(made.join(s, "l_suppkey").join(p, "l_partkey").select("block", *_KEYS, "identity", "quarter", "flags", "city", "p.p_brand", "p.p_type"))


def as_candidates(lines: DataFrame) -> DataFrame:
    """Candidates of rows of ``trip_lines``."""
    is_ = {x: F.col("flags").bitwiseAND(1 << i) != 0 for i, x in enumerate(_FLAGS)}
    return lines.select(
        "block", F.concat_ws("-", *_KEYS).alias("candidate"), "identity", F.concat_ws("-", F.floor(F.col("quarter") / 10), F.col("quarter") % 10).alias("date"), "city", F.col("p_brand").alias("title"),
        F.when(is_["proposal"], PROPOSAL).when(is_["note"], CITY_NOTE).alias("role"), F.when(is_["reference"], CITY_REFERENCE).alias("section_type"), *[is_[x].alias(x) for x in _FLAGS if x.startswith("has_")],
        F.col("l_orderkey").alias("stage"), F.col("l_linenumber").alias("item"), F.array(F.concat(F.lit("s"), "l_suppkey")).alias("blocks"), F.array("p_type").alias("labels"),
    )


def trip_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's line items as candidates of its trip, their orders' priority as the source they come from."""
    return as_candidates(trip_lines(spark, sf_dir, partitions(table(spark, sf_dir, "lineitem"))))


_NAME = "identity || '|' || date || '|' || city"
_WINDOWS_SQL = f"""WITH {_CANDIDATES_SQL},
d AS (SELECT block, identity, date, city, count(*) AS n, count(*) FILTER (has_time OR has_booking OR has_plan) AS f FROM c GROUP BY ALL),
g AS (SELECT p.block, 1 AS family, p.candidate AS key, p.stage AS s1, p.item AS s2, p.candidate AS s3, c.candidate, c.stage, c.item, CASE WHEN c.candidate = p.candidate THEN 0 ELSE 1 END AS pl FROM c p JOIN c ON p.proposal AND c.block = p.block AND c.identity = p.identity
  AND (c.candidate = p.candidate OR (c.date = p.date AND c.city = p.city))),
o AS (SELECT block, identity, date, city, min((stage, item, candidate)) AS first FROM c JOIN d USING (block, identity, date, city) WHERE reference OR (note AND NOT proposal) OR has_rec OR (NOT has_time AND NOT has_booking AND NOT has_plan AND n >= {CROWDED} AND f >= {FIXED}) GROUP BY ALL),
h AS (SELECT block, 2, {_NAME}, first[1], first[2], first[3], candidate, stage, item, 0 FROM c JOIN o USING (block, identity, date, city)),
s AS (SELECT block, identity, date, city, src, min((stage, item, candidate)) AS first FROM c WHERE NOT proposal AND NOT reference GROUP BY ALL HAVING count(*) > 1),
i AS (SELECT block, 3, {_NAME} || '|' || src, first[1], first[2], first[3], candidate, stage, item, 0 FROM c JOIN s USING (block, identity, date, city, src) WHERE NOT proposal AND NOT reference),
t AS (SELECT block, identity, title, min((stage, item, candidate)) AS first FROM c GROUP BY ALL HAVING count(DISTINCT date) > 1),
j AS (SELECT block, 4, identity || '|' || regexp_replace(title, '[^a-z0-9]+', ' ', 'g'), first[1], first[2], first[3], candidate, stage, item, 0 FROM c JOIN t USING (block, identity, title)),
w AS (SELECT * FROM g UNION ALL SELECT * FROM h UNION ALL SELECT * FROM i UNION ALL SELECT * FROM j),
m AS (SELECT *, row_number() OVER (PARTITION BY block, family, key ORDER BY pl, stage, item, candidate) AS nth FROM w QUALIFY nth <= {MEMBERS}),
a AS (SELECT block, family, key, s1, s2, s3, array_to_string(list(candidate ORDER BY nth), ',') AS members, list_sort(list(candidate)) AS same FROM m GROUP BY ALL),
u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY block, same ORDER BY family, s1, s2, s3, key) = 1)
SELECT block AS trip, CAST(row_number() OVER (PARTITION BY block ORDER BY family, s1, s2, s3, key) AS INTEGER) AS place, family, key, members FROM u QUALIFY place <= {WINDOWS}"""


@query(_WINDOWS_SQL)
def candidate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of each customer's line items.  The city is always given, so a proposal's scope is its source's day and city."""
    n = partitions(table(spark, sf_dir, "lineitem"))
    found = windows(trip_lines(spark, sf_dir, n, lambda d: staged(d, "lines")), n=n, made=as_candidates)
    return found.select(F.col("block").alias("trip"), "place", "family", "key", F.array_join("members", ",").alias("members"))


@query(f"""WITH {_CANDIDATES_SQL}, d AS (SELECT block, max(proposal OR n > 1) AS x FROM (SELECT block, bool_or(proposal) AS proposal, count(*) AS n FROM c GROUP BY block, stage, date, city) GROUP BY block),
t AS (SELECT block, max(n > 1) AS x FROM (SELECT block, count(DISTINCT date) AS n FROM c GROUP BY block, title) GROUP BY block) SELECT d.block AS trip, d.x OR t.x AS ambiguous FROM d JOIN t USING (block)""")
def ambiguous_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ambiguous(trip_candidates(spark, sf_dir)).select(F.col("block").alias("trip"), "ambiguous")
