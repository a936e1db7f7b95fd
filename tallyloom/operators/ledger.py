"""Content-addressed facts, conservation, violations, fingerprints and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table


def content_id(*columns: Column) -> Column:
    """A fact's id: the hash of its fields, null as empty, in the order given."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def digest(c: Column) -> Column:
    """60 bits of a hash as a number: sets are compared by exclusive or, without being gathered."""
    return F.conv(F.left(c, F.lit(15)), 16, 10).cast("bigint")


_FACTS = """f AS (SELECT sha256('order|' || o_orderkey || '|' || o_orderstatus) AS fact_id, 'order' AS kind, o_orderkey AS key, o_orderstatus AS flag FROM orders
 UNION ALL SELECT sha256('order|' || l_orderkey || '|' || l_linestatus), 'order', l_orderkey, l_linestatus FROM lineitem)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_id, kind, key, flag of two producers."""
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("flag"))
    li = table(spark, sf_dir, "lineitem").select(F.lit("order").alias("kind"), F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("flag"))
    return o.union(li).withColumn("fact_id", content_id(F.col("kind"), F.col("key"), F.col("flag")))


@query(f"WITH {_FACTS} SELECT flag, count(DISTINCT fact_id) AS n_facts, count(*) AS n_rows FROM f GROUP BY flag")
def fact_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = facts(spark, sf_dir).groupBy("flag", "fact_id").agg(F.count("*").alias("n"))
    return once.groupBy("flag").agg(F.count("*").alias("n_facts"), F.sum("n").alias("n_rows"))


@query(f"""WITH {_FACTS}, u AS (SELECT DISTINCT fact_id, flag FROM f)
SELECT flag AS universe, count(*) AS total, bit_xor(('0x' || left(fact_id, 15))::BIGINT) AS digest FROM u GROUP BY flag""")
def conservation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each universe's total and digest: nothing may come or go between two ledgers that agree in both."""
    return facts(spark, sf_dir).select("fact_id", "flag").distinct().groupBy(F.col("flag").alias("universe")).agg(F.count("*").alias("total"), F.bit_xor(digest(F.col("fact_id"))).alias("digest"))


@query("""SELECT 'dangling_part' AS code, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
UNION ALL SELECT 'dangling_order', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'duplicate_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'order_without_items', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def violations_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    named = lambda code, df: df.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")
    return (
        named("dangling_part", li.join(p, li["l_partkey"] == p["p_partkey"], "left_anti"))
        .union(named("dangling_order", li.join(o, li["l_orderkey"] == o["o_orderkey"], "left_anti")))
        .union(named("duplicate_line", li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c")).where("c > 1")))
        .union(named("order_without_items", o.join(li, o["o_orderkey"] == li["l_orderkey"], "left_anti")))
    )


@query("""WITH d AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events))
SELECT code, e.event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events e JOIN d USING (event_type) GROUP BY ALL""")
def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense codes in order of value: how many values have a smaller head, and how many smaller ones the same.
    Nothing but counts of heads, of two characters, stands in one window."""
    v = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users")).where("event_type is not null").withColumn("head", F.substring("event_type", 1, 2))
    heads = v.groupBy("head").agg(F.count("*").alias("values"))
    heads = heads.select("head", (F.sum("values").over(W.orderBy("head")) - F.col("values")).alias("before"))
    code = F.col("before") + F.row_number().over(W.partitionBy("head").orderBy("event_type")) - 1
    return v.join(heads, "head").select(code.cast("bigint").alias("code"), "event_type", "n", "users")


@query("""SELECT o_orderstatus AS section, count(*) AS n, bit_xor(('0x' || left(sha256(o_orderkey || '|' || o_custkey), 15))::BIGINT) AS fingerprint FROM orders GROUP BY 1""")
def section_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = digest(content_id(F.col("o_orderkey"), F.col("o_custkey")))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("section")).agg(F.count("*").alias("n"), F.bit_xor(fp).alias("fingerprint"))


_KEYED = "SELECT l_orderkey, count(*) AS n, bit_xor(('0x' || left(sha256(l_partkey || '|' || l_suppkey), 15))::BIGINT) AS fp FROM lineitem WHERE l_returnflag = '{0}' GROUP BY 1"


@query(f"""WITH a AS ({_KEYED.format('A')}), r AS ({_KEYED.format('R')})
SELECT CASE WHEN r.l_orderkey IS NULL THEN 'removed' WHEN a.l_orderkey IS NULL THEN 'added' WHEN a.fp = r.fp AND a.n = r.n THEN 'same' ELSE 'changed' END AS change, count(*) AS n FROM a FULL JOIN r ON a.l_orderkey = r.l_orderkey GROUP BY 1""")
def fingerprint_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose items differ between two states."""
    def state(flag: str, x: str) -> DataFrame:
        g = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).groupBy("l_orderkey")
        return g.agg(F.count("*").alias(f"n_{x}"), F.bit_xor(digest(content_id(F.col("l_partkey"), F.col("l_suppkey")))).alias(f"fp_{x}"))

    both = state("A", "a").join(state("R", "r"), "l_orderkey", "full")
    change = F.expr("case when n_r is null then 'removed' when n_a is null then 'added' when fp_a = fp_r and n_a = n_r then 'same' else 'changed' end")
    return both.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'final_only' ELSE 'compiled' END AS lineage, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def lineage_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("in_a")).distinct()
    b = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.lit(1).alias("in_b")).distinct()
    lineage = F.expr("case when in_b is null then 'missing' when in_a is null then 'final_only' else 'compiled' end")
    return a.join(b, "k", "full").groupBy(lineage.alias("lineage")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS span, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'R' THEN 2 ELSE 1 END AS rank FROM lineitem)
SELECT CASE best WHEN 3 THEN 'carried' WHEN 2 THEN 'structural' WHEN 1 THEN 'context' ELSE 'uncovered' END AS status, count(*) FILTER (n > 1) AS n_ambiguous, count(*) AS n
FROM (SELECT o_orderkey, max(rank) AS best, count(rank) AS n FROM orders LEFT JOIN e ON span = o_orderkey GROUP BY 1) GROUP BY 1""")
def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by their strongest carrier: carried over structural over context over none."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("span"), F.expr("case l_returnflag when 'A' then 3 when 'R' then 2 else 1 end").alias("rank")).distinct().groupBy("span").agg(F.max("rank").alias("best"), F.count("*").alias("n"))
    spans = table(spark, sf_dir, "orders").select("o_orderkey").join(e, F.col("o_orderkey") == F.col("span"), "left")
    status = F.expr("case best when 3 then 'carried' when 2 then 'structural' when 1 then 'context' else 'uncovered' end")
    return spans.groupBy(status.alias("status")).agg(F.count_if(F.col("n") > 1).alias("n_ambiguous"), F.count("*").alias("n"))
