"""Matching of candidates with records, and which of two cards wins.  Every join is by key, and what may be many is combined before it."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.staging import partitions
from ..plans.trips import ITEMS_SQL, LEGS_SQL, items, legs
from ..registry import query
from ..sources.tables import table


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT DISTINCT trip, day, l_orderkey, l_linestatus, s_nationkey = c_nationkey AS home FROM items JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = trip),
r AS (SELECT c.*, o_orderkey AS record, 4 + CASE WHEN o_orderstatus = l_linestatus THEN 2 ELSE 0 END + CASE WHEN home THEN 8 ELSE 0 END AS score
  FROM c JOIN orders ON o_custkey = trip AND CAST(o_orderdate AS DATE) = day WHERE home OR o_orderstatus = l_linestatus),
k AS (SELECT *, rank() OVER (PARTITION BY trip, day, l_orderkey, l_linestatus, home ORDER BY score DESC) AS rk FROM r)
SELECT trip, day, l_orderkey, l_linestatus, home, max(score) AS score, CAST(count(*) AS BIGINT) AS n_best, CASE WHEN count(*) = 1 THEN min(record) END AS record FROM k WHERE rk = 1 GROUP BY trip, day, l_orderkey, l_linestatus, home""")
def best_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each candidate item the record of its trip and day that agrees best; none if several do.  The day agrees by the
    join (4), the kind (2) and the place (8) may; one of these must.  Records of a day and kind are one row: which is best depends
    on no more.  Each join and group has as many parts as lines call for, so a task's share stays."""
    n = partitions(table(spark, sf_dir, "lineitem"))
    home = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    trip = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("trip"), "c_nationkey")
    i = items(spark, sf_dir, n).select("trip", "day", "l_orderkey", "l_linestatus", "l_suppkey")
    c = i.repartition(n, "l_suppkey").join(home, "l_suppkey").repartition(n, "trip").join(trip, "trip").select("trip", "day", "l_orderkey", "l_linestatus", (F.col("s_nationkey") == F.col("c_nationkey")).alias("home"))
    c = c.repartition(n, "trip", "day").distinct()
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trip"), F.to_date("o_orderdate").alias("day"), "o_orderstatus", "o_orderkey").repartition(n, "trip", "day").groupBy("trip", "day", "o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("record"))
    same = F.col("o_orderstatus") == F.col("l_linestatus")
    score = F.lit(4) + F.when(same, 2).otherwise(0) + F.when(F.col("home"), 8).otherwise(0)
    candidate = ["trip", "day", "l_orderkey", "l_linestatus", "home"]
    scored = c.join(r, ["trip", "day"]).where(F.col("home") | same).groupBy(*candidate, score.alias("score")).agg(F.sum("n").alias("n_best"), F.min("record").alias("record"))
    best = scored.groupBy(*candidate).agg(F.max(F.struct("score", "n_best", "record")).alias("b"))
    return best.select(*candidate, "b.score", "b.n_best", F.when(F.col("b.n_best") == 1, F.col("b.record")).alias("record"))


@query(f"""WITH {ITEMS_SQL}, e AS (SELECT o_custkey AS trip, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus, o_orderpriority = '1-URGENT' AS items_only FROM orders)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(count(*) AS BIGINT) AS n_rows, any_value(n) AS n_expected FROM (
  SELECT i.l_orderkey, i.l_linenumber, i.l_partkey, i.l_suppkey, i.l_quantity, i.l_extendedprice, count(*) AS n
  FROM (SELECT *, row_number() OVER () AS row_ FROM items) i JOIN e ON e.trip = i.trip AND e.month = CAST(date_trunc('month', i.day) AS DATE) AND o_orderstatus = l_linestatus AND (NOT items_only OR l_returnflag = 'N')
  GROUP BY i.row_, i.l_orderkey, i.l_linenumber, i.l_partkey, i.l_suppkey, i.l_quantity, i.l_extendedprice HAVING count(*) > 1) GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey""")
def expectation_overcompressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that answer more than one expectation of their trip and month.  An order expects an item of its status, an urgent one
    an unreturned item.  Expectations alike are counted before the join."""
    e = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("trip"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), F.col("o_orderstatus").alias("l_linestatus")).agg(F.count("*").alias("all"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    n = F.when(F.col("l_returnflag") == "N", F.col("all")).otherwise(F.col("all") - F.col("urgent"))
    found = items(spark, sf_dir).withColumn("month", F.to_date(F.date_trunc("month", "day"))).join(e, ["trip", "month", "l_linestatus"]).withColumn("n", n).where("n > 1")
    return found.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.count("*").alias("n_rows"), F.min("n").alias("n_expected"))


def first_unused(expectations: DataFrame, candidates: DataFrame) -> DataFrame:
    """group, expectation, candidate (null if missing): in order of ``expectation``, each takes the first candidate, in order of
    ``candidate``, of its group and label that is not taken, and of kind 'item' if it takes items only.  Both sides have group
    and label; a later expectation's choice depends on the earlier ones, so this is a fold over sorted rows: a task
    holds the open candidates of one group and label at a time."""
    types = dict(expectations.dtypes)
    name = lambda df: F.lit(None).cast(df)
    both = candidates.select("group", "label", F.lit(0).alias("turn"), F.col("candidate").alias("key"), (F.col("kind") == "item").alias("item")).union(
        expectations.select("group", "label", F.lit(1).alias("turn"), F.col("expectation").alias("key"), F.coalesce("items_only", name("boolean"), F.lit(False)).alias("item"))
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, open_ = None, {}
        for b in batches:
            out = []
            for group, label, turn, key, item in zip(b["group"], b["label"], b["turn"], b["key"], b["item"]):
                if (group, label) != at:
                    at, open_ = (group, label), {True: deque(), False: deque()}
                if turn == 0:
                    open_[bool(item)].append(key)
                    continue
                # heads of both queues; those of kind 'item' serve all expectations
                heads = [k for k in ((True,) if item else (True, False)) if open_[k]]
                took = min(heads, key=lambda k: open_[k][0], default=None)
                out.append((group, key, None if took is None else open_[took].popleft()))
            yield pd.DataFrame(out, columns=["group", "expectation", "candidate"])

    ordered = both.repartition("group", "label").sortWithinPartitions("group", "label", "turn", "key")
    return ordered.mapInPandas(fold, f"group {types['group']}, expectation {types['expectation']}, candidate {dict(candidates.dtypes)['candidate']}")


@query()
def expectation_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which item of its trip, month and status answers each order, each item once, in order of keys; null if none is left."""
    group, day = F.concat_ws("|", "trip", F.date_trunc("month", "day").cast("date").cast("string")), F.to_date("o_orderdate")
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trip"), day.alias("day"), "o_orderstatus", "o_orderkey", "o_orderpriority")
    e = e.select(group.alias("group"), F.col("o_orderstatus").alias("label"), F.col("o_orderkey").alias("expectation"), (F.col("o_orderpriority") == "1-URGENT").alias("items_only"))
    key = F.concat_ws("|", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    c = items(spark, sf_dir).select(group.alias("group"), F.col("l_linestatus").alias("label"), key.alias("candidate"), F.when(F.col("l_returnflag") == "N", "item").otherwise("other").alias("kind"))
    e = e.withColumn("expectation", F.lpad(F.col("expectation").cast("string"), 12, "0"))
    return first_unused(e, c)


@query(f"""WITH {ITEMS_SQL}, a AS (SELECT l_returnflag AS kind, day, CASE WHEN l_quantity > 25 THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS segment, l_orderkey, l_linenumber, l_extendedprice,
  CAST(l_discount > 0.05 AS INT) + CAST(l_tax > 0.04 AS INT) + CAST(l_quantity > 10 AS INT) + CAST(l_linestatus = 'F' AS INT) AS filled FROM items),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, day, segment ORDER BY filled DESC, l_orderkey, l_linenumber, l_extendedprice) AS rn FROM a)
SELECT kind, day, segment, count(*) AS n, max(filled) AS filled, max(CASE WHEN rn = 1 THEN l_orderkey END) AS l_orderkey, max(CASE WHEN rn = 1 THEN l_linenumber END) AS l_linenumber,
  string_agg(DISTINCT l_orderkey::VARCHAR, ',' ORDER BY l_orderkey::VARCHAR) AS provenance FROM r GROUP BY kind, day, segment HAVING count(*) > 1""")
def anchor_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of anchors alike in kind, day and segment - a number, or else a route - the one with most fields filled, the first of
    equals, with the sources of all."""
    filled = sum([F.when(F.expr(x), 1).otherwise(0) for x in ("l_discount > 0.05", "l_tax > 0.04", "l_quantity > 10", "l_linestatus = 'F'")], F.lit(0))
    segment = F.when(F.col("l_quantity") > 25, F.concat(F.lit("p"), "l_partkey")).otherwise(F.concat(F.lit("s"), "l_suppkey"))
    a = items(spark, sf_dir).select(F.col("l_returnflag").alias("kind"), "day", segment.alias("segment"), "l_orderkey", "l_linenumber", "l_extendedprice", filled.alias("filled"))
    best = F.min(F.struct((-F.col("filled")).alias("least"), "l_orderkey", "l_linenumber", "l_extendedprice"))
    g = a.groupBy("kind", "day", "segment").agg(F.count("*").alias("n"), best.alias("b"), F.array_join(F.array_sort(F.collect_set(F.col("l_orderkey").cast("string"))), ",").alias("provenance")).where("n > 1")
    return g.select("kind", "day", "segment", "n", (-F.col("b.least")).alias("filled"), "b.l_orderkey", "b.l_linenumber", "provenance")


RUNGS = ["eligibility", "booking", "named_venue", "commitment", "specificity", "title_quality"]
_CARDS_SQL = """c AS (SELECT o_custkey AS trip, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderkey AS card,
  CAST(o_orderstatus <> 'P' AS INT) AS eligibility, CAST(o_orderpriority = '1-URGENT' AS INT) AS booking, CAST(o_totalprice >= 100000 AS INT) AS named_venue,
  6 - CAST(left(o_orderpriority, 1) AS INT) AS commitment, coalesce(n, 0) AS specificity, least(length(o_orderpriority), 100) - CASE WHEN o_orderpriority = '3-MEDIUM' THEN 50 ELSE 0 END AS title_quality
  FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


@query(f"""WITH {_CARDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY trip, month ORDER BY {", ".join(f"{x} DESC" for x in RUNGS)}, card) AS rn FROM c),
p AS (SELECT a.trip, a.month, a.card AS winner, b.card AS runner_up, CASE {" ".join(f"WHEN a.{x} <> b.{x} THEN '{x}'" for x in RUNGS)} ELSE 'tie' END AS rung FROM r a JOIN r b ON b.trip = a.trip AND b.month = a.month AND b.rn = 2 WHERE a.rn = 1)
SELECT * FROM p""")
def merge_winner_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best card of each trip and month against the next, and the rung that decides: cards are compared rung by rung, and equal
    ones by key.  Two maxima by struct, no window over a trip."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_partkey").alias("n"))
    o = table(spark, sf_dir, "orders").join(n, "o_orderkey", "left")
    flag = lambda x: F.when(F.expr(x), 1).otherwise(0)
    rungs = [
        flag("o_orderstatus != 'P'"), flag("o_orderpriority = '1-URGENT'"), flag("o_totalprice >= 100000"), 6 - F.left("o_orderpriority", F.lit(1)).try_cast("int"), F.coalesce("n", F.lit(0)),
        F.least(F.length("o_orderpriority"), F.lit(100)) - F.when(F.col("o_orderpriority") == "3-MEDIUM", 50).otherwise(0),
    ]
    card = F.struct(*[r.alias(x) for r, x in zip(rungs, RUNGS)], (-F.col("o_orderkey")).alias("card"))
    c = o.select(F.col("o_custkey").alias("trip"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), card.alias("c"))
    first = c.groupBy("trip", "month").agg(F.max("c").alias("a"))
    both = c.join(first, ["trip", "month"]).where("c.card != a.card").groupBy("trip", "month", "a").agg(F.max("c").alias("b"))
    rung = F.coalesce(*[F.when(F.col(f"a.{x}") != F.col(f"b.{x}"), x) for x in RUNGS], F.lit("tie"))
    return both.select("trip", "month", (-F.col("a.card")).alias("winner"), (-F.col("b.card")).alias("runner_up"), rung.alias("rung"))


@query(f"""WITH {LEGS_SQL}, {ITEMS_SQL}, p AS (SELECT leg, trip, arrive, coalesce(leave, arrive) AS leave, o_orderpriority AS city FROM legs JOIN orders ON o_orderkey = leg),
d AS (SELECT trip, o_orderpriority AS city, day, count(*) AS n FROM items JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
x AS (SELECT d.trip, d.n, EXISTS (SELECT 1 FROM p WHERE p.trip = d.trip AND p.city = d.city AND d.day BETWEEN arrive AND leave) AS ok FROM d)
SELECT trip, CAST(sum(n) AS BIGINT) AS n_items, CAST(coalesce(sum(n) FILTER (ok), 0) AS BIGINT) AS n_allowed FROM x GROUP BY trip""")
def range_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose day a leg of their own city holds, both ends included: so it is if the latest end of the legs that have begun is
    not before the day.  One window over the days of a trip and city."""
    city = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("city"))
    l = legs(spark, sf_dir).join(city, F.col("leg") == F.col("key")).groupBy("trip", "city", F.col("arrive").alias("at")).agg(F.max(F.coalesce("leave", "arrive")).alias("leave"))  # noqa: E741
    d = items(spark, sf_dir).join(city, F.col("l_orderkey") == F.col("key")).groupBy("trip", "city", F.col("day").alias("at")).agg(F.count("*").alias("n"))
    both = l.withColumn("n", F.lit(None).cast("bigint")).unionByName(d.withColumn("leave", F.lit(None).cast("date")))
    reach = F.max("leave").over(W.partitionBy("trip", "city").orderBy("at").rangeBetween(W.unboundedPreceding, 0))
    x = both.withColumn("reach", reach).where("n is not null")
    return x.groupBy("trip").agg(F.sum("n").alias("n_items"), F.coalesce(F.sum(F.when(F.col("reach") >= F.col("at"), F.col("n"))), F.lit(0)).alias("n_allowed"))


@query("""WITH b AS (SELECT DISTINCT o_custkey AS trip, l_suppkey AS block, l_orderkey AS member FROM lineitem JOIN orders ON o_orderkey = l_orderkey), n AS (SELECT trip, count(DISTINCT member) AS members FROM b GROUP BY 1)
SELECT trip, any_value(members) AS members, count(*) AS n_blocks, min(block) AS first_block FROM (SELECT trip, block, count(*) AS k FROM b GROUP BY ALL) JOIN n USING (trip) WHERE k = members OR 5 * k >= 2 * members GROUP BY trip""")
def common_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that all of a trip's orders share, or two fifths at least."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("trip"))
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("block")).distinct().join(o, "l_orderkey")
    members = b.select("trip", "l_orderkey").distinct().groupBy("trip").agg(F.count("*").alias("members"))
    k = b.groupBy("trip", "block").agg(F.count("*").alias("k")).join(members, "trip").where("5 * k >= 2 * members")
    return k.groupBy("trip", "members").agg(F.count("*").alias("n_blocks"), F.min("block").alias("first_block")).select("trip", "members", "n_blocks", "first_block")


@query("""SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1""")
def counts_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by day; those without one do not count."""
    return table(spark, sf_dir, "lineitem").where("l_shipdate is not null").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"))


@query("""WITH done AS (SELECT user_id, min(ts) AS done FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT e.user_id, count(*) FILTER (done IS NULL OR ts < done) AS n_failed, count(*) FILTER (ts >= done) AS n_skipped, left(arg_min(props, (ts, event_id)), 1000) AS message
FROM events e LEFT JOIN done USING (user_id) WHERE event_type = 'error' GROUP BY e.user_id""")
def run_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each run: those after it has completed are skipped, the others fail it; with the first one's message."""
    e = table(spark, sf_dir, "events")
    done = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("done"))
    errors = e.where("event_type = 'error'").join(done, "user_id", "left")
    late = F.coalesce(F.col("ts") >= F.col("done"), F.lit(False))
    return errors.groupBy("user_id").agg(F.count_if(~late).alias("n_failed"), F.count_if(late).alias("n_skipped"), F.left(F.min_by("props", F.struct("ts", "event_id")), F.lit(1000)).alias("message"))


@query("""SELECT s_suppkey, count(c_custkey) AS n_legs, min(c_custkey) AS first_leg FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey GROUP BY s_suppkey""")
def note_legs_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note attaches to every leg of its city: legs are counted by city before notes meet them."""
    legs_ = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_leg"))
    return table(spark, sf_dir, "supplier").join(legs_, "s_nationkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n_legs"), "first_leg")


@query("""WITH v AS (
  SELECT 'absent_from_evidence' AS code, p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)
  UNION ALL SELECT DISTINCT 'no_output_entity', l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey IS NOT NULL)
  UNION ALL SELECT 'duplicate_identity', l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
  UNION ALL SELECT 'missing_identity', l_orderkey FROM lineitem WHERE l_partkey IS NULL
  UNION ALL SELECT DISTINCT 'dangling_review', user_id FROM events WHERE event_type <> 'error' AND user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey IS NOT NULL))
SELECT code, id, count(*) AS n FROM v GROUP BY ALL""")
def identity_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the identities of parts, as entities, by items, as evidence, and of reviews, unless dismissed, that aim at nothing."""
    li, p, e, s = (table(spark, sf_dir, t) for t in ("lineitem", "part", "events", "supplier"))
    named = lambda code, df, c: df.select(F.lit(code).alias("code"), F.col(c).alias("id"))
    used = li.where("l_partkey is not null").select(F.col("l_partkey").alias("p_partkey")).distinct()
    v = (
        named("absent_from_evidence", p.join(used, "p_partkey", "left_anti"), "p_partkey")
        .union(named("no_output_entity", used.join(p.select("p_partkey"), "p_partkey", "left_anti"), "p_partkey"))
        .union(named("duplicate_identity", li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1"), "l_orderkey"))
        .union(named("missing_identity", li.where("l_partkey is null"), "l_orderkey"))
        .union(named("dangling_review", e.where("event_type != 'error'").select(F.col("user_id").alias("s_suppkey")).distinct().join(s.select("s_suppkey"), "s_suppkey", "left_anti"), "s_suppkey"))
    )
    return v.groupBy("code", "id").agg(F.count("*").alias("n"))


_MONTHS = "january february march april may june july august september october november december".split()
_FORMS = [
    "'Wednesday, ' || m || ' ' || d || 'th - the old town'", "'## **' || m || ' ' || d || '**'", "'Day 3 in town, ' || m || ' ' || d", "d || '/' || k || '/2026 arrival'", "'- Lunch at ' || d",
    "repeat('x', 150) || m", "'• ' || 'TUE ' || upper(left(m, 3)) || ' ' || d", "'  ' || m || ' ' || d || ' with blanks before'", "'Budget: $900'",
]


@query(f"""WITH r AS (SELECT o_orderkey, [{", ".join(f"'{x}'" for x in _MONTHS)}][1 + month(o_orderdate) % 12] AS m, CAST(day(o_orderdate) AS VARCHAR) AS d, CAST(month(o_orderdate) AS VARCHAR) AS k, o_orderkey % {len(_FORMS)} AS f FROM orders),
x AS (SELECT o_orderkey, CASE f {" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_FORMS))} END AS raw FROM r),
t AS (SELECT o_orderkey, raw, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\\s+', ' ', 'g'), '^[-*•●▪◦>·]+\\s*', ''), '^#+\\s*', ''), '[*_`]', '', 'g')) AS s FROM x)
SELECT o_orderkey, raw, s <> '' AND length(s) <= 140 AND regexp_matches(s, '{T.DAY_HEADING}') AS heading FROM t""")
def text_day_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the forms that headings come in, each with whether it is the heading of a day."""
    o = table(spark, sf_dir, "orders")
    m = F.element_at(F.array(*[F.lit(x) for x in _MONTHS]), 1 + F.month("o_orderdate") % 12)
    r = o.select("o_orderkey", m.alias("m"), F.dayofmonth("o_orderdate").cast("string").alias("d"), F.month("o_orderdate").cast("string").alias("k"), (F.col("o_orderkey") % len(_FORMS)).alias("f"))
    raw = F.coalesce(*[F.when(F.col("f") == i, F.expr(x)) for i, x in enumerate(_FORMS)])
    return r.select("o_orderkey", raw.alias("raw")).withColumn("heading", T.is_day_heading(F.col("raw")))
